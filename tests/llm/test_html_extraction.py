import html as entities
import re

import numpy as np

from tidemark.llm import html_extraction as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/x>Home</a></li>
<li><a href=/y>News</a></li></ul></nav><!-- <p>no</p> --><div class="cookie notice">We use cookies</div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>
 text<br>here<p>Second&nbsp;one<p>Third paragraph of the story, with some words</article>
<section class="comments"><p>great post</p></section><footer>&copy; 2020 the site</footer>"""


def _article(html):
    own = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", own)]
    return "\n".join(p for p in parts if p)


def test_blocks():
    got = [(b.tag, b.text) for b in hx.blocks(PAGE)]
    assert got == [("li", "Home"), ("li", "News"), ("div", "We use cookies"), ("h1", "A & B"), ("p", "First bold text here"), ("p", "Second one"), ("p", "Third paragraph of the story, with some words"), ("p", "great post"), ("footer", "© 2020 the site")]
    assert hx.blocks(None) == [] and [b.text for b in hx.blocks("a < b <p>c<!-- open")] == ["a < b", "c"]


def _texts(html):
    return [b.text for b in hx.blocks(html)]


def test_hidden_elements():
    kept = "<article><p>hello</p></article>"
    for before in ('<svg viewBox="0 0 1 1"/>', "<svg>", "<svg><text>x</text>", "<script/>", "<script>var a = 1;", "<style>p{", "<select><option>a<option>b</select>", "<datalist><option>a<option>b</datalist>", "<option>a<option>b", "<textarea>a", "<button>", "<noscript>", "<iframe>", "<head><title>T</title>", "<html><title>T"):
        assert _texts(before + kept)[-1:] == ["hello"], before
    for hidden in ("<svg><text>x</text></svg>", "<script>x</script>", "<button><div>x</div></button>", "<select><option>x<option>y</select>", "<noscript><p>x</p></noscript>", "<object><p>x</object>"):
        assert _texts(f"<p>one {hidden}two</p><p>three</p>") == ["one two", "three"], hidden
    assert _texts("<div><svg><g></div><p>a") == ["a"] and _texts("<svg><g><p>a</p></svg>b") == ["a", "b"]


def test_deep_pages_take_memory_by_blocks():
    import tracemalloc

    tracemalloc.start()
    page = hx.blocks("<div>x" * 100_000)
    assert len(page) == 100_000 and page[-1].depth == 100_000 and hx.features(page).shape == (100_000, hx.INPUT)
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()


def test_pages_without_semantic_markup(spark):
    """The article's own tag is a plain ``div`` on every page, on nine of ten, and on every second."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: _article(r["html"]) for r in pages.collect()}
    for kept in (0, 1, 5):
        less = pages.selectExpr("page_id", "url", rf"case when page_id % 10 < {kept} then html else regexp_replace(html, '(</?)article', '$1div') end as html")
        got = {r["page_id"]: r["text"] for r in hx.extract(less).collect()}
        assert np.mean([got[i] == want[i] for i in want]) > 0.95


def test_generated_pages_are_told_apart():
    """Held-out pages of the generator, by a labeller that saw no given page."""
    model = hx.Labeller()
    model.train(hx.training_pages([]))
    made, right = hx._Pages(99), []
    for _ in range(100):
        page = hx.blocks(made.page())
        right += [(s >= 0.5) == b.told for s, b in zip(model.scores(*hx.padded([hx.features(page)]))[0], page)]
    assert np.mean(right) > 0.95


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = hx.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, live = hx.padded([rng.standard_normal((4, hx.INPUT)), rng.standard_normal((2, hx.INPUT))])
    y = np.array([[1, 0, -1, 1], [0, 1, 0, 0]])
    _, grads = model.gradients(x, live, y)
    for name in ("hf", "xb", "bf", "o"):
        w = model.w[name]
        at = np.unravel_index(int(np.abs(grads[name]).argmax()), w.shape)
        held, step = w[at], 1e-3
        w[at] = held + step
        up = model.gradients(x, live, y)[0]
        w[at] = held - step
        down = model.gradients(x, live, y)[0]
        w[at] = held
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at]))


def test_given_pages(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: _article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in hx.extract(pages, fit_pages=100).collect()}
    assert set(got) == set(want)
    assert np.mean([got[i][0] == want[i] for i in want]) > 0.95
    assert all(n == len(t) for t, n in got.values())


def test_edge_rows(spark, sf):
    own = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    rows = [(1001, None, None), (1002, "u", ""), (1003, "u", "<html><body><nav>a</nav>"), (None, "u", PAGE), (1005, "u", "<article>" + "<p>word and more words of it</p>" * 3000 + "</article>")]
    pages = own.union(spark.createDataFrame(rows, "page_id long, url string, html string")).selectExpr("*", "1 as text")
    got = {r["page_id"]: r["text"] for r in hx.extract(pages, fit_pages=80).collect()}
    assert got[1001] == "" and got[1002] == "" and "Second one" in got[None] and "cookies" not in got[None]
    assert got[1005].count("word and more words of it") >= 2900
    twice = hx.extract(pages.union(pages), fit_pages=80).groupBy("page_id", "text").count().collect()
    assert all(r["count"] == 2 for r in twice if r["page_id"] is not None)
    assert hx.extract(pages.limit(0)).collect() == []


def test_untagged_text_does_not_hang_on_what_lies_beside_it(spark, sf):
    plain = [(1, "u", "One plain sentence without any markup."), (2, "u", "Two lines\nof <b>text</b> &amp; a <i>word</i>.<br>More."), (3, "u", '<a href="x">Home</a> <a href="y">About us</a>')]
    docs = spark.createDataFrame(plain, "page_id long, url string, html string")
    alone = {r.page_id: r.text for r in hx.extract(docs).collect()}
    beside = {r.page_id: r.text for r in hx.extract(docs.withColumn("page_id", -docs.page_id).union(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))).collect()}
    assert alone[1] == "One plain sentence without any markup." and alone[2] == "Two lines of text & a word. More."
    assert all(beside[-k] == alone[k] for k in (1, 2))
