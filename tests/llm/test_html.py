import random
import time

import pytest

from filtra.llm import html_extract as H

W = H.PageWeights(tag={"p": 0.05, "h1": 0.05, "b": 0.05, "li": 0.4, "a": 0.5, "div": 0.2})

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now please.</div>
<article><h1>Head &amp; tail</h1><p><b>First   para
graph.<br><p>Second &lt;p&gt; &eacute;&#233;&amp;amp;</p><div class="cookie-notice">We use cookies.</div><form><input value="x">Send</form>
<p>One.</p><ul><li>item one</li><li>item two</li></ul><aside>Side talk</aside><section id="comments"><p>First!</p></section><p>Last words</p></article>
<footer>&copy; x</footer></body></html>"""


def learned():
    """Weights as the test tables give them: articles of headings and paragraphs, menus, adverts and footers beside them."""
    text = " ".join(["word"] * 30) + "."
    page = (
        "<nav><ul><li><a>m</a></li><li><a>n</a></li></ul></nav><div class='ad'>Buy this now please.</div>"
        f"<article><h1>One of many heads</h1><p><b>{text}</b><br>{text}</p><p>{text}</p></article><footer>&copy; 2020 x</footer>"
    )
    inside, outside = H.Counter(), H.Counter()
    for _ in range(200):
        for b in H.blocks(page):
            (inside if b.level else outside).update({"", *b.like, *(m for _, m in b.marks), *(f"<{t}" for t in b.tags)})
    return H.PageWeights.learn(inside, outside)


@pytest.fixture(params=["prior", "learned"])
def weights(request):
    return W if request.param == "prior" else learned()


def test_article(weights):
    want = "Head & tail\nFirst para graph.\nSecond <p> éé&amp;\nOne.\nitem one\nitem two\nLast words"
    assert H.extract(PAGE, weights) == want


def test_no_markers_takes_the_densest_run(weights):
    text = " ".join(f"word{i}" for i in range(60))
    page = f"<body><div class='menu'><a>a</a><a>b</a></div><div><p>{text}</p><p>{text}</p></div><div id='sidebar'>{text}</div></body>"
    assert H.extract(page, weights) == f"{text}\n{text}"


def test_unmarked_menu_and_copyright_without_an_article(weights):
    text = " ".join(["word"] * 40) + "."
    page = f"<ul><li><a>Home</a></li><li><a>About us</a></li></ul><div><h1>The head</h1><p>{text}</p><p>{text}</p></div><div>Copyright 2024 Example Inc</div><p><a>x</a></p>"
    assert H.extract(page, weights) == f"The head\n{text}\n{text}"


def test_reader_comments_in_articles(weights):
    text = " ".join(["word"] * 40) + "."
    inner = f"<article class='post'><p>{text}</p><article class='comment'><p>I liked it very much.</p></article><p>The end.</p></article>"
    assert H.extract(inner, weights) == f"{text}\nThe end."
    beside = f"<article class='post'><p>{text}</p><p>The end.</p></article><article class='comment'><p>I liked it very much.</p></article>"
    assert H.extract(beside, weights) == f"{text}\nThe end."


def test_main_text_in_unusual_elements(weights):
    page = (
        "<article><p>Use <label>this</label> and <math><mi>x</mi></math> here.</p><section class='discussion'><p>We discuss it.</p></section>"
        "<p class='search'>To search is to find.</p><noscript><p>No script needed.</p></noscript><dialog open>They said so.</dialog>"
        "<table><tr><td>cell one<td>cell two</table><ul><li><a href='x'>linked item</a></li></ul><header><h2>Inner head</h2></header></article>"
    )
    want = "Use this and x here.\nWe discuss it.\nTo search is to find.\nNo script needed.\nThey said so.\ncell one\ncell two\nlinked item\nInner head"
    assert H.extract(page, weights) == want


def test_a_mark_on_what_holds_the_page_says_nothing(weights):
    text = " ".join(["word"] * 40) + "."
    assert H.extract(f"<form><div class='with-sidebar'><article class='has-comments'><p>{text}</p></article></div></form>", weights) == text
    assert H.extract(f"<form><div class='with-sidebar'><p>{text}</p></div></form>", weights) == text


def test_shapes(weights):
    assert H.extract(None, weights) == H.extract("", weights) == H.extract("<p> <br></p>", weights) == ""
    assert H.extract("plain text &amp; more is here as well.", weights) == "plain text & more is here as well."
    assert H.extract("<article><p>a<p>b</article>", weights) == "a\nb"
    assert H.extract("<article>x <i>y</i>z<script>no</script></article>tail", weights) == "x yz"
    assert H.extract("<main><div hidden>no</div><p title='a>b'>yes</p></main>", weights) == "yes"
    assert H.extract("<article>" + "<p>w</p>" * 5000, weights).count("\n") == 4999
    assert H.extract("<article><p>kept</p><div class='advert'><div>x</div> y</div><p>too</p></article>", weights) == "kept\ntoo"
    assert H.extract("<article><p>1 < 2 and it's \"so\" <b>here</b></article>", weights) == "1 < 2 and it's \"so\" here"
    assert H.extract("<article><p>a</p></article><p class='x", weights) == "a"


def test_kept_paragraphs_of_one_word(weights):
    gaps = "<div class='ad'>x</div>" * 30
    assert H.extract(f"<article><p>{'long ' * 50}</p>{gaps}<p>End.</p></article>", weights).endswith("\nEnd.")


def test_the_weights_decide():
    text = " ".join(["word"] * 30) + "."
    page = f"<div><p>{text}</p></div><div><blockquote>{text} Quoted.</blockquote></div>"
    assert H.extract(page, W) == f"{text}\n{text} Quoted."
    other = H.PageWeights({**W.weight, "block:blockquote": -4.0}, W.tag)
    assert H.extract(page, other) == text
    costly = H.PageWeights(W.weight, {"div": 40.0})
    assert H.extract(page, costly) == text


def test_best_run_against_all_runs():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 8)
        gains, costs = [rng.uniform(-3, 3) for _ in range(n)], [rng.uniform(0, 2) for _ in range(n)]
        value = lambda a, b: sum(gains[a:b]) - sum(costs[a + 1 : b])  # noqa: B023, E731
        best = max([0.0] + [value(a, b) for a in range(n) for b in range(a + 1, n + 1)])
        a, b = H.best_run(gains, costs)
        assert (value(a, b) if b else 0.0) == pytest.approx(best)


@pytest.mark.parametrize("part", ['<a "', '<a href="x', "<b class='", "<!--", "<p>x", "</p", "<script>", "<title>", "&", "<div class='a b'>x", "<a href=\"'>", "<svg>"])
def test_hostile_pages_take_linear_time(part):
    began = time.perf_counter()
    H.extract("<article><p>text " + part * (400_000 // len(part)), W)
    assert time.perf_counter() - began < 20


def test_table(spark):
    names = ["text", "tag", "page", "x"]
    df = spark.createDataFrame([(1, "u", PAGE, *names), (1, "u", PAGE, *names), (2, None, None, *names), (None, "u", "", *names)], ["page_id", "url", "html", *names])
    w = H.learn_weights(df)
    assert set(H.SEMANTIC) <= set(w.weight) and all(abs(x) <= 6 for x in w.weight.values())
    rows = H.extract_text(df, w, out="main").collect()
    assert len(rows) == 4 and sorted(r.main for r in rows)[:2] == ["", ""] and all([r[n] for n in names] == names for r in rows)
    assert H.extract_text(df.limit(0), w, out="main").count() == 0
    assert H.learn_weights(df.limit(0)) == H.PageWeights()
    with pytest.raises(ValueError):
        H.extract_text(df, w)
