"""Character references in expressions against the standard library's own decoding."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from citewell.functions import text as T
from citewell.functions.entities import unescape_html


def test_all_names_numbers_and_broken_references(spark):
    r, names = random.Random(1), list(html5)
    cases = ["&" + n for n in names] + ["&" + n.rstrip(";") + "x" for n in names[:600]]
    cases += ["a & b", "&", "&&amp;&", "&amp;copy;", "&ampx;", "&notit;", "&#233;", "&#xe9;", "&#XE9", "&#0;", "&#x80;", "&#129;", "&#55296;", "&#1114112;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFFF;", "&#1;", "&#11;", "&#13;", "&#127;"]
    cases += ["&#xFDD0;", "&#x1FFFE;", "&#x1F600;", "&#;", "&#x;", "&#xZ;", "", "plain", "&eacute&hellip;x", "&\n", "&#000000000065;", "&am", "&amp"]
    cases += ["".join(r.choice(["&", "#", "x", "3", "9", "a", "m", "p", ";", " ", "lt", "é", "&copy", "&#"]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(cases), (-1, None)], "i int, t string").repartition(4)
    got = {x["i"]: x["u"] for x in df.select("i", unescape_html(F.col("t")).alias("u")).collect()}
    assert got.pop(-1) is None
    assert [c for i, c in enumerate(cases) if got[i] != html.unescape(c)] == []


def test_cleaning_resolves_all_of_them_without_python(spark):
    df = spark.createDataFrame([("<p>&#233;t&eacute;&hellip;</p>&amp;lt; &lt;b&gt;",)], "h string").select(T.clean_html(F.col("h")).alias("t"))
    assert df.first()["t"] == "été…\n\n&lt; <b>"
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
