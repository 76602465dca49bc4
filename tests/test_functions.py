"""Literal pairs for column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from citewell.functions import overlap, vectors
from citewell.functions import text as T
from citewell.operators import chunking, rules


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v if hasattr(v, "_jc") else F.lit(v))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function,given,want",
    [
        (T.lexical_form, "الْحَمْدُ", "الحمد"),
        (T.lexical_form, "الرَّحْمَٰن", "الرحمن"),
        (T.lexical_form, "مصــــر", "مصر"),
        (T.lexical_form, "ٱلرَّحْمَٰن", "ٱلرحمن"),
        (T.lexical_form, "  a \n\n b\t", "a b"),
        (T.lexical_form, "\n\n", ""),
        (T.match_form, "أَبَاهُ", "اباه"),
        (T.match_form, "مُؤْمِنِين", "مومنين"),
        (T.match_form, "ءَاثَرَك", "اثرك"),
        (T.match_form, "خَطِئِين", "خطيين"),
        (T.match_form, "رَحْمَةٍ", "رحمه"),
        (T.search_fold, "ءَايَـٰتُ ٱلْكِتَـٰبِ", "ءايت الكتب"),
        (T.strip_basmala, "بسم الله الرحمن الرحيم قل هو", "قل هو"),
        (T.strip_basmala, "بسم", "بسم"),
        (T.strip_basmala, "قل بسم الله", "قل بسم الله"),
        (T.clean_html, '<p>A <span class="x">B :</span> C</p>', "A B : C"),
        (T.clean_html, "<p>A</p><p>B</p>", "A\n\nB"),
        (T.clean_html, "<p>x &lt;k&gt; &amp; y</p>", "x <k> & y"),
        (T.clean_html, "plain text", "plain text"),
        (T.model_of_url, "https://h/v1/models/m-1:generate", "m-1"),
        (T.model_of_url, "https://h/x", "https://h/x"),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, function(F.col("t")), t=given) == want


def test_letter_key_joins_hamza_spellings(spark):
    assert one(spark, T.letter_key(F.col("t")), t="ءامن") == one(spark, T.letter_key(F.col("t")), t="آمن")
    assert one(spark, T.letter_key(F.col("t")), t="شيء") != one(spark, T.letter_key(F.col("t")), t="شي")


@pytest.mark.parametrize("given,n", [("a\n\nb", 2), ("a\nb", 1), ("a\r\n\r\nb", 2), ("a\n \n\n\nb", 2), (" \n ", 0), ("", 0)])
def test_paragraphs(spark, given, n):
    assert len(one(spark, T.split_paragraphs(F.col("t")), t=given)) == n


@pytest.mark.parametrize("given,cap", [("word " * 12, 20), ("x" * 50 + " y", 20), ("short", 20), ("", 5), ("a b  c", 3)])
def test_packing_forms_agree(spark, given, cap):
    built = one(spark, T.pack_words(F.col("t"), cap), t=given)
    assert built == one(spark, T.pack_words_udf(cap)(F.col("t")), t=given)
    assert all(len(p) <= cap or " " not in p for p in built)


def test_chunk_id_is_a_nul_terminated_hash(spark):
    got = one(spark, T.chunk_id(*[F.lit(x) for x in ("s", "v", 1, 2, "multi_ayah", "h", 0)]))
    assert got == hashlib.sha256(b"s\0v\x001\x002\0multi_ayah\0h\x000\0").hexdigest()


@pytest.mark.parametrize(
    "verse,passage,run",
    [("قالوا سنرود عنه اباه", "قال قالوا سنرود عنه اباه وانا لفعلون", 4), ("سنرود عنه اباه", "عنه ثم اباه ولم يذكر سنرود", 1), ("a b", "", 0), (" ".join(f"w{i}" for i in range(90)), "x " * 500 + " ".join(f"w{i}" for i in range(90)) + " y", 90), ("a b c d", "b c x a b c", 3)],
)
def test_quoted_run(spark, verse, passage, run):
    assert one(spark, overlap.longest_quoted_run(F.col("v"), F.col("p")), v=verse, p=passage) == run


@pytest.mark.parametrize("verse,passage,want", [("قالوا", "قالوا", 1.0), ("some words here", "", 0.0), ("", "some words", 0.0), ("a longer verse text", "a longer verse text", 1.0), ("abcdefghij", "xx abcdefgh yy", 1 / 3)])
def test_coverage(spark, verse, passage, want):
    assert one(spark, overlap.quote_coverage(F.col("v"), F.col("p")), v=verse, p=passage) == pytest.approx(want)


def test_coverage_plans_agree(spark):
    verses = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "tiny"), (3, "")], "verse_id int, text string")
    passages = spark.createDataFrame([(1, "see the quick brown fox jumps over"), (2, "a tiny thing"), (3, None), (4, "quick brown")], "passage_id int, text string")
    joined = {tuple(r) for r in overlap.coverage_pairs(verses, passages, least=0.1).collect()}
    indexed = {tuple(r) for r in overlap.coverage_pairs_indexed(verses, passages, least=0.1).collect()}
    assert joined == indexed and joined


def test_short_items_are_found_on_both_sides_of_the_switch(spark):
    verses = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "tiny"), (3, ""), (4, "a"), (5, "brown f"), (6, "tiny"), (7, "absent"), (8, "eightlng")], "verse_id int, text string")
    passages = spark.createDataFrame([(1, "see the quick brown fox jumps over"), (2, "a tiny tiny thing"), (3, None), (4, "tiny"), (5, ""), (6, "x eightlng y")], "passage_id int, text string")
    below = {tuple(r) for r in overlap.coverage_pairs_indexed(verses, passages, least=0.1).collect()}
    above = {tuple(r) for r in overlap.coverage_pairs_indexed(verses, passages, least=0.1, max_windows=1).collect()}
    pairs = verses.crossJoin(passages.withColumnRenamed("text", "p")).withColumn("c", overlap.quote_coverage(F.col("text"), F.col("p")))
    assert below == above
    assert {(r[0], r[1]): r[4] for r in above} == {(r["verse_id"], r["passage_id"]): r["c"] for r in pairs.where("c >= 0.1").collect()}
    assert {(2, 2, 1, 1, 1.0), (2, 4, 1, 1, 1.0), (5, 1, 1, 1, 1.0), (6, 4, 1, 1, 1.0)} <= above


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 0.0], 0), ([3.0, 4.0], [6.0, 8.0], 1)])
def test_cosine(spark, a, b, want):
    array = lambda v: F.array(*map(F.lit, v))
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=array(a), b=array(b)) == pytest.approx(want)


@pytest.mark.parametrize("x,want", [(1.0, "1"), (0.5, "0.5"), (-0.25, "-0.25"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-5, "1e-05"), (0.0001, "0.0001"), (123.456, "123.456"), (0.0, "0"), (1.5e-7, "1.5e-07")])
def test_shortest_decimal(x, want):
    assert vectors.shortest_decimal(x) == want


def test_embedding_hash(spark):
    f = vectors.embedding_hash_udf()
    got = one(spark, f(F.col("m"), F.col("v")), m="m", v=F.array(F.lit(1.0), F.lit(0.5)))
    assert got == hashlib.sha256(b"m\x001\x000.5\x00\x01").hexdigest()


@pytest.mark.parametrize("kind,s,e,ok", [("single_ayah", 4, 4, True), ("multi_ayah", 4, 6, True), ("surah_level", 0, 0, True), ("thematic", 0, 0, True), ("single_ayah", 4, 5, False), ("single_ayah", 0, 0, False), ("multi_ayah", 6, 4, False), ("thematic", 1, 2, False), ("odd", 1, 1, False), ("multi_ayah", 4, 4, True)])
def test_range_valid(spark, kind, s, e, ok):
    assert one(spark, chunking.range_valid(F.lit(kind), F.lit(s), F.lit(e))) is ok


def test_draft_rules(spark):
    reason = lambda text, style="en", claims=0, refs=0, review=True: one(spark, rules.draft_reason(F.lit(text), F.lit(claims), F.lit(refs), F.lit(review), F.lit(style)))
    assert reason("text " * 390) is None
    assert reason("") == "empty" and reason("x" * 2005) == "too_long" and reason("x", claims=1) == "claims_without_refs"
    assert reason("x", review=False) == "review_not_required" and reason("قال", "simplified_ar") is None
    assert reason("abc", "simplified_ar") == "no_arabic" and reason("قال abcdef", "simplified_ar") == "mostly_latin" and reason("x", "fr") == "unknown_style"


def test_references(spark):
    got = one(spark, rules.resolve_positions(F.array(*map(F.lit, ["1", "x", "0", "3", "2", "1"])), F.array(F.lit("a"), F.lit("b"))))
    assert got["resolved"] == ["a", "b", "a"] and len(got["warnings"]) == 3
    assert one(spark, rules.resolve_claim_refs(F.array(*map(F.lit, ["1", "b", "1", "zz"])), F.array(F.lit("a"), F.lit("b")))) == ["a", "b", None]


def test_claims_and_introductions(spark):
    claims = spark.sql("select array(named_struct('text', 'one', 'source_refs', array('1')), named_struct('text', 'two', 'source_refs', array('b', '1'))) c, array('a', 'b') ids, array(named_struct('text', 'one', 'source_refs', array('1', 'a'))) bad")
    row = claims.select(rules.claims_valid(F.col("c"), F.col("ids")), rules.claims_valid(F.col("bad"), F.col("ids")), rules.section_content(F.col("c")), rules.section_refs(F.col("c"))).first()
    assert tuple(row) == (True, False, "one two", ["1", "b"])


def test_decode_output(spark):
    rows = spark.createDataFrame([('{"content":"x"}',), ("",), (None,), ("{bad",), ('{"promptFeedback":{"blockReason":"SAFETY"}}',)], "raw string")
    got = [r["x"]["error"] for r in rows.select(rules.decode_output(F.col("raw"), "content string").alias("x")).collect()]
    assert got == [None, "empty", "empty", "malformed", "blocked"]


def test_request_body(spark):
    got = one(spark, rules.request_body(F.lit("brief"), F.array(F.lit("p"), F.lit("q"))))
    assert got == '{"system":"brief","evidence":"[1] p\\n[2] q"}'


def test_small_tables_in_few_files_are_dealt_over_the_cores(spark, tmp_path):
    from citewell.sources import tables

    spark.range(500).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(500).repartition(9).write.parquet(str(tmp_path / "many.parquet"))
    one, many = (tables.text_table(spark, str(tmp_path), x, "id") for x in ("one", "many"))
    assert "RoundRobinPartitioning" in one._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" not in many._jdf.queryExecution().toString()
    assert sorted(r[0] for r in one.collect()) == sorted(r[0] for r in many.collect()) == list(range(500))
