import pytest
from pyspark.sql import functions as F

from capturelake.llm import html
from capturelake.llm.html import blocks, default_model, extract, labelled_pages, main_text

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy things now.</div>
<article><h1>Title &amp; more &lt;b&gt;</h1><p><b>First   words\n of it.<br><p>Second &eacute; part, with text and more text.</p>
<div class="comments"><p>I like this one.</p><p>Me too, thanks.</p></div></article>
<aside class="sidebar">Other stories</aside><form><label>Mail</label><button>Send</button></form><footer>&copy; site</footer></body></html>"""


def test_blocks():
    got = [b.text for b in blocks("<div>a<p>b<p>c <i>d</i></div>e<br>f<script>x<</script>g<!-- h -->i &amp;amp; < 5 <unclosed")]
    assert got == ["a", "b", "c d", "e fgi &amp; < 5"]
    assert blocks("<script>never ends <p>x</p>") == [] and blocks("") == []


def test_article():
    assert main_text(PAGE, default_model()) == "Title & more <b>\nFirst words of it.\nSecond é part, with text and more text."


def test_held_out_pages():
    pages, labels = labelled_pages(150, seed=5)
    model = default_model()
    pairs = [(x, y) for p, want in zip(pages, labels, strict=True) for x, y in zip(model.decode(p), want, strict=True)]
    assert sum(x == y for x, y in pairs) / len(pairs) > 0.98


def test_viterbi_equals_enumeration():
    import itertools

    model = default_model()
    for page in [p for p in labelled_pages(40, seed=8)[0] if len(p) <= 9]:
        e = model.emissions(page)
        score = lambda y: model.start[y[0]] + sum(e[t, k] for t, k in enumerate(y)) + sum(model.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(page)), key=score)
        assert abs(score(best) - score(model.decode(page))) < 1e-9


def test_edge_cases(spark):
    long = "<article>" + "".join(f"<p>Sentence number {i} of the text, it is here.</p>" for i in range(20000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (4, "u", long), (5, "u", "<<<>>> </p></div> <p")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash")).repartition(2)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages).collect()}
    assert extract(pages).count() == 6
    assert got[1] == ("u", "", 0) and got[2] == (None, "", 0) and got[3][1].startswith("Title")
    assert got[4][1].count("\n") == 19999 and got[4][2] == len(got[4][1])
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nested_and_stray_tags_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        blocks("<div>" * n + "<p>text</p>" + "</section>" * n + "</div>" * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(8000) < 20 * seconds(1000) + 0.5


def test_text_of_embedded_elements_stays():
    page = "<article><p>Let <math><mi>x</mi></math> be <object>seven</object> of <canvas>nine</canvas>.</p><script>no</script></article>"
    assert [b.text for b in blocks(page)] == ["Let x be seven of nine."]


def test_null_ids_and_repeats(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1><p>Some words of an article, long enough to be one.</p></article></body></html>"
    rows = [(None, None, page), (1, "u", page), (1, "u", page), (2, "u", None)]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    text = "Title of it\nSome words of an article, long enough to be one."
    assert got == [(0, text, len(text)), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]


def test_names_of_the_article_and_around_it_are_no_noise():
    """An article may be named like a part that never holds one, or stand in such a part; parts beside it may have any name."""
    body = "<h1>Title of it</h1><p>Some words of an article, long enough to be one, with stops.</p><p>Another paragraph of it follows here. It has two sentences.</p>"
    menu, foot = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<footer>&copy; site</footer>"
    want = "Title of it\nSome words of an article, long enough to be one, with stops.\nAnother paragraph of it follows here. It has two sentences."
    for middle in [
        f"<article>{body}</article>",
        f"<article class='search-engine-history'>{body}</article>",
        f"<div class='social-science comment-on-law'><article>{body}</article></div>",
        f"<article>{body}</article><div class='cta-strip'><p>Try it free today</p></div>",
        f"<article>{body}<div class='comments'><p>I like this one. Me too, thanks.</p></div></article>",
        f"<article>{body}</article><aside class='related'><article><p>Other story that you may like, read on.</p></article></aside>",
    ]:
        assert main_text(f"<html><body>{menu}{middle}{foot}</body></html>", default_model()) == want


PARAGRAPHS = ["Some words of an article, long enough to be one, with stops.", "Another paragraph of it follows here. It has two sentences.", "The third paragraph goes on, as articles do, for a while.", "A fourth one, with more to say about the matter at hand.", "The fifth and last paragraph ends the story, as it should."]
SAID = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("title", ["", "<h1>Title of it</h1>"])
@pytest.mark.parametrize(
    "middle",
    [
        SAID, f"<div>{SAID}</div>", *(f'<div class="{c}">{SAID}</div>' for c in ("legal-analysis", "newsletter-archive", "promo-code-guide", "search-results")),
        f'<div class="social-science comment-on-law"><article>{SAID}</article></div>', f'<article>{SAID}<div class="cta-strip"><p>Try it free today</p></div></article>',
        f"<article>{SAID}<button>Subscribe now</button></article>", f"<article><script src=/js/>var leak=1;</script>{SAID}</article>",
    ],
)
def test_articles_that_no_name_gives_away_or_a_name_denies(title, middle):
    """No class names at all, names of parts that hold no article, and boxes and buttons inside the article."""
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>{title}{middle}<footer>&copy; site</footer></body></html>"
    want = "\n".join(PARAGRAPHS)
    assert main_text(page, default_model()) in ((want, f"Title of it\n{want}") if title else (want,))


def test_held_out_pages_without_any_names(monkeypatch):
    monkeypatch.setattr(html, "BARE", 1.0)
    pages, labels = labelled_pages(200, seed=21)
    pairs = [(x, y) for p, want in zip(pages, labels, strict=True) for x, y in zip(default_model().decode(p), want, strict=True)]
    assert sum(x == y for x, y in pairs) / len(pairs) > 0.98


def test_slashes_of_values_and_of_tags():
    assert [b.text for b in blocks("<p>a</p><script src=/js/>var leak=1;</script><p>b</p><script src='x'/><p>c</p><iframe src=x /><p>d</p>")] == ["a", "b", "c", "d"]


def test_many_names_in_deep_nests_take_linear_time():
    import time

    def seconds(n):
        page = "".join(f"<div class='n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>" for i in range(n)) + "<p>text</p>" + "</div>" * n
        began = time.perf_counter()
        blocks(page, default_model().index)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(8000) < 20 * seconds(1000) + 0.5


def test_extraction_equals_the_articles_of_given_pages():
    """Brute force over pages whose article is marked: its text without comments and forms, by a plain walk."""
    import os
    import re

    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(at):
        pytest.skip("no tables here")
    checked = 0
    for row in pq.read_table(at).to_pylist():
        found = re.findall(r"<article>(.*?)</article>", row["html"] or "", re.S)
        if len(found) != 1:
            continue
        inner = [b.text for b in blocks(f"<article>{found[0]}</article>")]
        got = main_text(row["html"], default_model()).split("\n")
        assert set(got) <= set(inner) and [x for x in inner if x in set(got)] == got
        checked += 1
    assert checked > 5
