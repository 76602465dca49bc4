"""Ordered files: the same bytes as a plain writer, differences by line, digests and their errors."""

import pytest

from citewell.sources import ordered_text as O
from citewell.sources import tables


def test_corpus_has_the_bytes_of_a_plain_writer_and_reads_back(spark, tmp_path):
    rows = [(12, a, f"text {a}\nline two été") for a in range(400, 0, -1)] + [(2, 1, "small group"), (12, 401, None)]
    sections = spark.createDataFrame(rows, "group_id int, anchor int, text string").repartition(7)
    path = f"{tmp_path}/c.md"
    n = O.write_text(O.corpus_lines("Title", sections), path)
    want = "# Title\n\n" + "".join(f"## {g}:{a}\n\n{t or ''}\n\n" for g, a, t in sorted(rows, key=lambda r: r[:2]))
    assert (tmp_path / "c.md").read_text(encoding="utf-8") == want and n == len(want.encode())
    assert {(r["anchor"], r["text"]) for r in tables.read_corpus(spark, path, 12).collect()} == {(a, t or "") for g, a, t in rows if g == 12}


def test_check_mode_finds_lines_that_differ(spark, tmp_path):
    sections = spark.createDataFrame([(1, a, f"t{a}") for a in range(1, 30)], "group_id int, anchor int, text string")
    lines, path = O.corpus_lines("T", sections), f"{tmp_path}/c.md"
    assert O.differences(lines, path).count() > 0  # no file yet
    O.write_text(lines, path)
    assert O.differences(lines, path).count() == 0
    text = (tmp_path / "c.md").read_text()
    (tmp_path / ".c.md.crc").unlink()  # the local file system's checksum of what was written
    (tmp_path / "c.md").write_text(text.replace("t7\n", "other\n", 1))
    assert [(r["is_there"], r["should_be"]) for r in O.differences(lines, path).collect()] == [("other", "t7")]
    (tmp_path / "c.md").write_text(text + "more\n")
    assert [(r["is_there"], r["should_be"]) for r in O.differences(lines, path).collect()] == [("more", None)]


def test_digest_joins_verses_and_compares_below_its_header(spark, tmp_path):
    sections = spark.createDataFrame([(1, 2, 7, 0.5, "corroborated"), (1, 1, 0, 0.25, "uncorroborated")], "group_id int, anchor int, run int, coverage double, verdict string")
    verses = spark.createDataFrame([(1, 1, "first\nverse"), (1, 2, "second")], "group_id int, anchor int, text string")
    lines, path = O.digest_lines("D", {"source": "s", "at": "monday"}, sections, verses), f"{tmp_path}/d.md"
    O.write_text(lines, path)
    assert (tmp_path / "d.md").read_text() == "at: monday\nsource: s\n\n---\n# D\n\n| place | run | coverage | verdict | verse |\n| --- | --- | --- | --- | --- |\n| 1:1 | 0 | 0.25 | uncorroborated | first verse |\n| 1:2 | 7 | 0.50 | corroborated | second |\n"
    later = O.digest_lines("D", {"source": "s", "at": "tuesday"}, sections, verses)
    assert O.differences(later, path).count() == 1 and O.differences(later, path, after="---").count() == 0
    with pytest.raises(Exception, match="no verse 1:2"):
        O.write_text(O.digest_lines("D", {}, sections, verses.where("anchor = 1")), path)
