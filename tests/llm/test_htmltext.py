import random
import time

import numpy as np
import pytest

from ledgerloom.llm import htmltext
from ledgerloom.llm.catalog import QUERIES


def texts(page):
    return [b.text for b in htmltext.parse(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p></p><br>") == []
    assert texts("<title>t</title><div><p>a<b>b</b>c<br>d &amp; &eacute;&#233;\n <p>e</div>f</div>g") == ["abc d & éé", "e", "fg"]
    assert texts('x <a title="1>2">y</a> < z <3 <script>var a = "</p>";<p></script><style>p{}</style>w<!-- <p>no</p> -->v <p un') == ["x y < z <3", "wv"]
    assert texts("a<p title='b>c</p>d") == ["a", "c", "d"]
    assert texts("<ul><li>a<li><a href=/x>b</a></ul>c &am") == ["a", "b", "c &am"]
    linked = htmltext.parse('<nav class="Top menu"><a href="/">home</a> x</nav>')[0]
    assert linked.path == ("nav", ".top", ".menu") and linked.linked == 4
    for page in ("<a" * 100_000, "<a '" * 50_001 + ">", "<b>" * 50_000 + "x", "<" * 100_000, "&" * 100_000, "<p>x" * 20_000):
        htmltext.parse(page)


def test_gradients():
    rng = random.Random(1)
    page = htmltext._layout(rng, ["aa", "bb", "cc"])
    blocks, truth = [b for b, _ in page], np.array([y for _, y in page], np.float64)
    parts = htmltext.describe(blocks)
    model = htmltext.Labeller(htmltext.Labeller().flat.astype(np.float64))

    def loss():
        logit = model.scores(model.inputs(*parts)[:, None, :].astype(np.float64))[:, 0]
        return np.mean(np.log1p(np.exp(-np.where(truth == 1, logit, -logit))))

    gradient = model.gradients(*parts, truth)
    for i in np.argsort(-np.abs(gradient))[:200:10]:
        kept, values = model.flat[i], []
        for step in (1e-2, -1e-2):
            model.flat[i] = kept + step
            values.append(loss())
        model.flat[i] = kept
        assert abs((values[0] - values[1]) / 2e-2 - gradient[i]) < 1e-3 + 0.05 * abs(gradient[i])


def test_labels_of_layouts_never_seen():
    words = [f"w{i}" for i in range(300)]
    model = htmltext.Labeller(htmltext.train(words, layouts=250, epochs=4))
    rng, wrong, total = random.Random(77), 0, 0
    for _ in range(60):
        page = htmltext._layout(rng, words[::2] + [f"new{i}" for i in range(100)])
        if page:
            content = model.scores(model.inputs(*htmltext.describe([b for b, _ in page]))[:, None, :])[:, 0] > 0
            wrong += sum(bool(c) != bool(y) for c, (_, y) in zip(content, page))
            total += len(page)
    assert wrong / total < 0.05


def test_registered_query_against_the_articles(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in QUERIES["op2_html_extraction"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert sorted(rows) == sorted(p.page_id for p in pages)
    for p in pages:
        want = " ".join(b.text for b in htmltext.parse(p.html) if "article" in b.path)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want) and rows[p.page_id].url == p.url


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (None, "u", "<script>", 3)], "page_id long, url string, html string, text int")
    assert [r.text for r in htmltext.extract(df).collect()] == ["", "", ""]
    assert htmltext.extract(df.where("false")).count() == 0


def test_embedded_elements_lose_no_later_block():
    for tag in ("svg", "object", "canvas", "select"):
        assert texts(f"<p>a</p><{tag} x=1><b>no</b><p>no</p></{tag}><p>b") == ["a", "b"]
        assert texts(f"<div><p>a</p><{tag}></div><p>b</p><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a</p><{tag}><p>b</p><{tag}>no<{tag}>no</{tag}>no</{tag}><p>c</p>") == ["a", "b", "c"]
        htmltext.parse(f"<{tag}>x" * 3000 + f"</{tag}>" * 3000)
    assert texts("<p>a</p><svg class='icon'/><p>b</p><svg/><p>c</p><svg><title/><style/><path d=''/>no</svg><p>d</p>") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><svg class=i/>no</svg><p>b") == ["a", "b"]
    assert texts("<p>a</p><textarea><p>no</p></textarea><iframe><p>no</p></iframe><p>b") == ["a", "b"]


def test_whole_paths_and_blocks_are_read():
    grid = '<div class="col-xs-12 col-sm-6 col-md-4 row">'
    page = lambda box, text: htmltext.parse(f"<{box}>{grid * 80}<p>{text}</p>{'</div>' * 80}</{box}>")
    names = [f"n{chr(97 + i)}" for i in range(20)]
    wide = htmltext.parse(f'<div class="{" ".join(names)}">x</div>')[0]
    assert wide.path == ("div", *(f".{n}" for n in names))
    model, x = htmltext.Labeller(), lambda blocks: model.inputs(*htmltext.describe(blocks))
    assert page("nav", "x")[0].path.count(".col") == 240 and page("nav", "x")[0].path[0] == "nav"
    assert not np.allclose(x(page("nav", "x"))[0, : htmltext.VECTOR], x(page("article", "x"))[0, : htmltext.VECTOR], atol=1e-6)
    words = [f"w{i}" for i in range(3000)]
    blocks = page("nav", " ".join(words)) + htmltext.parse("top <b>a</b>")
    got = x(blocks)
    for row, block in zip(got, blocks):
        path = [model.p["path"][htmltext._bucket(n, htmltext.PATHS)] for n in block.path] or [model.p["path"][0]]
        text = [model.p["word"][htmltext._bucket(w, htmltext.WORDS)] for w in block.text.split()]
        assert np.allclose(row[: 2 * htmltext.VECTOR], np.hstack([np.sum(path, axis=0) / len(path) ** 0.5, np.mean(text, axis=0)]), atol=1e-5)
    deep = htmltext.parse("<div class='a b'>x" * 20_000)
    assert len(deep) == 20_000 and x(deep).shape[0] == 20_000


def test_deciding_containers_above_deep_grids():
    model = htmltext.Labeller(htmltext.train([f"w{i}" for i in range(300)]))
    grid, text = '<div class="col-xs-12 col-sm-6 col-md-4 row">', "<p>One two three four five. Six seven eight nine ten.</p>" * 3
    nested = lambda name, inner: f'<div class="{name}">{grid * 6}{inner}{"</div>" * 7}'
    blocks = htmltext.parse("<html><body>" + nested("menu", "<ul><li><a href=x>w1</a><li><a href=x>w2 w3</a></ul>") + nested("article-body", text) + nested("comments", text) + nested("footer", "<p>w4 w5</p>"))
    content = model.scores(model.inputs(*htmltext.describe(blocks))[:, None, :])[:, 0] > 0
    assert content.tolist() == ["article" in " ".join(b.path) for b in blocks]


@pytest.mark.parametrize("unit", ["<div>{}", "<b>{}", "<b>x{}"])
@pytest.mark.parametrize("end", ["</em>", "</div x>", "<h1>", "<li>y", "</nosuch>", "<p>", "<option>"])
def test_time_is_linear_in_open_elements(unit, end):
    """A page of 400 to 700 KB: tags that close nothing, or look for what they close, after very many open elements."""
    n = 40_000
    page = unit.format("") * n + end * n
    began = time.process_time()
    htmltext.parse(page)
    assert time.process_time() - began < 5
