"""Main text of pages: the scan against all stretches, pages of many shapes, and the given pages' own articles."""

import html
import itertools
import random
import re
from collections import Counter

import pytest

from citewell.llm import main_text as M

P = "<p>First words of the real text, long enough to count as such.</p>"
Q = "<p>Second <b>bold</b>face words &amp; an entity&nbsp;here.</p>"
TEXT = "First words of the real text, long enough to count as such. Second boldface words & an entity here."
AROUND = '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>{}</body></html>'


@pytest.fixture(scope="module")
def scores(sf):
    import duckdb

    counts = Counter()
    for (page,) in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall():
        counts.update(M.counted(page or ""))
    return M.Scores(counts)


def test_scan_finds_the_largest_sum():
    r = random.Random(1)
    for _ in range(300):
        s = [r.choice([-3, -1, 0, 1, 2]) for _ in range(r.randint(0, 9))]
        all_of = {(i, j): sum(s[i : j + 1]) for i, j in itertools.combinations_with_replacement(range(len(s)), 2)}
        found = M.best_stretch(s)
        assert (all_of[found] if found else 0) == max([0, *all_of.values()])


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><a href=/>Home</a></nav><article>{P}{Q}</article><footer>foot</footer>",
        f"<header><h1>Site</h1></header><main><article>{P}<div class='ad'>Buy now</div>{Q}</article><aside>Side bar words</aside></main>",
        f"<div id=top-nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><div class=content>{P}{Q}</div><div class='sidebar'>More words of a side bar</div>",
        f"<main>{P}{Q}</main><section id='comments'><p>Great article, I liked it a lot, and so on.</p></section>",
        f"<article>{P}{Q}<div class='comment-list'><article class='comment'><p>A reader says many words.</p></article></div></article>",
        f"<div role=banner>Brand</div><div role=main>{P}<form action=/s><label>Mail</label><input><button>Send</button></form>{Q}</div><div role=contentinfo>c</div>",
        f"<div class='cookie-notice'>We use cookies on this site to know you.</div><div>{P}{Q}</div><div class=newsletter-box>Subscribe to our letter</div>",
        f"<form id=aspnet><div>{P}{Q}</div></form>",
        f"<form id=aspnet><nav>Menu</nav><article>{P}{Q}</article></form>",
        f"<article><header><p class=meta>By someone</p></header>{P}<!-- a comment > --><script>if (a < b) x('<p>')</script>{Q}<footer>Tags</footer></article>",
        f"<div class='has-sidebar post'>{P}{Q}</div><ul class='related-posts'><li><a href=x>Other</a></li></ul>",
        f"<ARTICLE>{P.replace('</p>', '')}{Q.upper().replace('SECOND', 'Second').replace('BOLD', 'bold').replace('FACE WORDS', 'face words').replace('AN ENTITY', 'an entity').replace('HERE', 'here').replace('&AMP;', '&amp;').replace('&NBSP;', '&nbsp;')}</ARTICLE><div class=promo>x",
    ],
)
def test_pages_of_many_shapes(scores, body):
    assert M.main_text(AROUND.replace("{}", body), scores) == TEXT
    assert M.main_text(AROUND.replace("{}", body), M.Scores({})) == TEXT  # first scores


def test_references_white_space_and_broken_ends(scores):
    cases = {
        None: "",
        "": "",
        " \n ": "",
        "<p>": "",
        "plain words < 3 & more": "plain words < 3 & more",
        "<p>a\n\t b&#233;&eacute;&#x1F600;</p>c<br>d": "a béé\U0001f600 c d",
        "<p>kept words of a text</p><p": "kept words of a text",
        "<p>kept words of a text</p><!-- never closed <p>x</p>": "kept words of a text",
        "<p>kept words of a text</p><script>never closed": "kept words of a text",
        "<p title='a > b'>kept words of a text</p></nothing></p>": "kept words of a text",
        "<nav>only a menu</nav>": "",
        "wo<i>r</i>d<wbr>s of a text": "words of a text",
    }
    for page, text in cases.items():
        assert M.main_text(page, scores) == text, page


def test_long_and_deep_pages_take_linear_time(scores):
    assert M.main_text("<div>" * 50_000 + "<p>words in the deep</p>", scores) == "words in the deep"
    assert len(M.main_text("<article>" + "<p>some words here" * 50_000, scores).split()) == 150_000
    assert M.main_text("<a " * 100_000, scores) == ""
    assert M.main_text("</x" * 100_000 + "<" * 100_000, scores) != "x"


def test_given_pages_give_their_articles(spark, sf):
    got = M.extract(spark.read.parquet(f"{sf}/pages.parquet")).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    assert sorted(got["page_id"]) == sorted(pages.index)
    for page_id, url, text, n in got.itertuples(index=False):
        article = re.search(r"<article>(.*)</article>", pages.loc[page_id, "html"], re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (text, n, url) == (want, len(want), pages.loc[page_id, "url"])


def test_learned_scores_carry_over_to_pages_without_a_mark(spark, sf, scores):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert M.main_text(bare, scores) == M.main_text(r["html"], scores)


def test_rows_stay_as_they_are(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>some words of a page</p>", None), (2, "v", "<p>some words of a page</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(M.extract(df).collect(), key=str)
    assert sorted((r["page_id"] is None, r["text"], r["n_chars"]) for r in got) == [(False, "", 0), (False, "", 0), (False, "some words of a page", 20), (True, "some words of a page", 20)]
    assert M.extract(df.limit(0)).collect() == []
