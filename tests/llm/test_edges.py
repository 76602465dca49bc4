"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from citewell.llm import fixity, language, lattice_lm, mixing, near_dedup, order_minhash, packing, prefix_forest, quality, secrets
from tests.llm.helpers import awkward

OPERATORS = {
    "mix": lambda docs: mixing.mix(docs),
    "mixed_documents": lambda docs: mixing.mixed_documents(docs),
    "language": lambda docs: language.predict(docs, language.learn(docs)),
    "fingerprints": lambda docs: order_minhash.fingerprints(docs),
    "secrets": lambda docs: secrets.scan(docs),
    "redacted": lambda docs: secrets.redacted(docs),
    "lattice": lambda docs: lattice_lm.score(docs, F.col("doc_id") % 2 == 0),
    "quality": lambda docs: quality.score(docs, quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))),
    "near_duplicates": lambda docs: near_dedup.near_duplicates(docs),
    "deduplicated": lambda docs: near_dedup.deduplicated(docs),
    "pack": lambda docs: packing.pack(docs),
}
ONE_A_ROW = {"mix", "language", "fingerprints", "secrets", "redacted", "lattice", "quality", "near_duplicates"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, spark):
    docs = awkward(spark)
    rows = OPERATORS[name](docs).collect()
    if name in ONE_A_ROW:
        assert len(rows) == docs.count()
    assert rows


def by_text(rows, docs, column):
    """doc_id -> the set of values of a column, for ids that are not null."""
    out = {}
    for r in rows:
        if r["doc_id"] is not None:
            out.setdefault(r["doc_id"], set()).add(r[column])
    return out


def test_defined_values_of_awkward_rows(spark):
    """What the docstrings say about null, empty, equal and repeated texts."""
    docs = awkward(spark)
    mixed = mixing.mix(docs).collect()
    sizes = by_text(mixed, docs, "size")
    assert sizes[0] == sizes[1] == sizes[2] == sizes[99] == {0} and sizes[10] == {40_000} and sizes[4] == {12}
    assert all(r["taken"] == 0 for r in mixed if r["size"] == 0) and all(r["taken"] <= 2 * r["size"] for r in mixed)
    near = near_dedup.near_duplicates(docs).collect()
    component, n = by_text(near, docs, "component_id"), by_text(near, docs, "n_shingles")
    assert component[4] == component[5] == component[6] == component[7] == {4} and n[0] == n[1] == n[2] == {0} and n[3] == {1}
    assert component[0] == {0} and component[1] == {1} and component[99] == {99}  # empty sets are linked with nothing
    assert sum(r["kept"] for r in near if r["doc_id"] == 4) == 3  # repeated rows of the component's id
    language_rows = language.predict(docs, language.learn(docs)).collect()
    predicted, score = by_text(language_rows, docs, "lang_pred"), by_text(language_rows, docs, "score")
    assert predicted[0] == predicted[1] == predicted[2] == {"und"} and score[0] == {0.0} and predicted[4] <= {"en", "fr"}
    packed = packing.pack(docs).collect()
    lengths = by_text(packed, docs, "length")
    assert lengths[0] == lengths[1] == lengths[2] == lengths[99] == {1} and max(lengths[10]) == 2048
    assert sum(r["doc_id"] == 4 for r in packed) == 3
    prints = by_text(order_minhash.fingerprints(docs).collect(), docs, "fingerprint")
    assert prints[0] == prints[1] == prints[99] == {"0" * 512} and prints[4] == prints[5] != prints[6]
    lattice = by_text(lattice_lm.score(docs, F.col("doc_id") % 2 == 0).collect(), docs, "n_tokens")
    assert lattice[0] == lattice[1] == {1} and lattice[3] == {2}
    rated = by_text(quality.score(docs, fitted(docs)).collect(), docs, "score")
    assert rated[0] == rated[1] == rated[99] and rated[4] == rated[5] and all(0 <= x <= 1 for v in rated.values() for x in v)


def fitted(docs):
    return quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))


def test_columns_with_the_names_that_operators_use(spark):
    names = ["_t", "_l", "_bits", "_tie", "_doc", "_q_chars", "_text", "own", "rules", "doc", "t", "tie", "_gone", "_row", "id"]
    docs = spark.createDataFrame([(1, "secret: abcdefgh and more words", "s"), (2, "other words here", "s")], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    kept = lambda df: [tuple(r[n] for n in names) for r in df.collect()]
    want = tuple(f"own {n}" for n in names)
    assert set(kept(secrets.scan(docs))) == set(kept(secrets.redacted(docs))) == set(kept(near_dedup.deduplicated(docs))) == set(kept(mixing.mixed_documents(docs))) == {want}
    scored = quality.score(docs, quality.RuleEnsemble([], [], 0.0))
    assert [r["_t"] for r in scored.collect()] == ["own _t"] * 2 and mixing.mix(docs).count() == 2


def test_the_shared_folder_is_not_a_local_one_on_a_cluster(spark, monkeypatch):
    from citewell.llm import common

    class Conf:
        def get(self, name, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Sc:
                    def getCheckpointDir(self):  # noqa: N802
                        class Nothing:
                            def isDefined(self):  # noqa: N802
                                return False

                        return Nothing()

                return Sc()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_scratch_deletes_all_but_results(spark):
    import os

    from citewell.llm import common

    with common.scratch("result") as result:
        inner = common.keep(spark.range(5), "inner").inputFiles()[0]
        out = result(spark.range(7))
    assert out.count() == 7 and not os.path.exists(inner.removeprefix("file://"))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark):
    assert OPERATORS[name](awkward(spark).where("false")).collect() == []


@pytest.mark.parametrize("name", ["mixed_documents", "redacted", "deduplicated"])
def test_stages_keep_the_columns(name, spark):
    docs = awkward(spark)
    assert OPERATORS[name](docs).columns == docs.columns


def test_redaction_leaves_other_columns_and_clean_texts(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: r for r in secrets.redacted(docs).where("doc_id is not null").collect()}
    assert got[11]["text"] == "[SECRET] token: 123" and got[11]["spans"] == "x"
    assert got[4]["text"].startswith("one two") and got[0]["text"] is None


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 1.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    found = prefix_forest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 8, 0.0)]
    assert prefix_forest.nearest(table.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_fixity_edges(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (2, None, None), (None, "u", ""), (3, "u", "x" * 100_000)], "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    records = fixity.archived(pages)
    assert records.count() == 5 and fixity.audit(records, records).collect() == []
    empty = records.where("false")
    assert {r["kind"] for r in fixity.audit(records, empty).collect()} == {"missing"}
    assert {r["kind"] for r in fixity.audit(empty, records).collect()} == {"extra"} and fixity.audit(empty, empty).collect() == []


def test_next_documents_of_large_ids_and_nulls(spark):
    big = 2**62 + 1
    rows = [(big + i, f"text number {i} and more words") for i in range(5)] + [(None, "no id"), (None, "no id"), (-(2**62), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = order_minhash.fingerprints(table).collect()
    h = order_minhash.OrderMinHash()
    ordered = [t or "" for _, t in rows[4::-1]] + [""] + ["no id", "no id"]
    want = {i: order_minhash.likeness(h.signature(ordered[k]), h.signature(ordered[(k + 1) % 8])) for k, i in enumerate([big + 4, big + 3, big + 2, big + 1, big, -(2**62)])}
    assert {r["doc_id"]: r["near_next"] for r in got if r["doc_id"] is not None} == want
    assert sorted(r["near_next"] for r in got if r["doc_id"] is None)[-1] == 1.0 and len(got) == 8


def test_packing_keeps_large_ids_beside_nulls(spark):
    big = 2**62 + 1
    table = spark.createDataFrame([(big, "a b"), (None, "c d"), (big + 2, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(table).collect()} == {big, None, big + 2}
