import math
import re
import time
from zlib import crc32

import numpy as np
import pytest

from weft.llm import html, queries


@pytest.fixture(scope="module")
def weights():
    return html.train()


def test_blocks():
    page = (
        "<!doctype html><html><head><title>no</title><style>p{a:'<p>'}</style></head><body><!-- <p>no --><div class='Side-Bar x1'>a &amp; <a href='>'>b</a>"
        "<script>if(a<b){}</script><p>one<br>two <b>three<p>4 < 5 &eacute;&#233;</p><ul><li>x<li>y</ul>tail</div><p>end<p"
    )
    got = html.blocks(page)
    assert [b.text for b in got] == ["a & b", "one two three", "4 < 5 éé", "x", "y", "tail", "end"]
    assert [b.tag for b in got] == ["div", "p", "p", "li", "li", "div", "p"]
    assert got[0].linked == pytest.approx(1 / 5) and got[0].named and not got[-1].named
    assert html.blocks(None) == html.blocks("") == html.blocks("<p></p><script>x") == []


def test_network_gradients():
    rng = np.random.default_rng(3)
    made = html.training_pages(3, seed=2)
    bl = [html.blocks(p) for p, _ in made]
    y = np.array([f for _, fs in made for f in fs], float)
    lengths, s = np.array([len(b) for b in bl]), html.sparse(bl, html.WordSlots())
    w = html.train(pages=20, epochs=1)

    def loss(w):
        p = np.concatenate(html.label(w, bl, html.WordSlots()))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = html._gradients(w, lengths, s, y)
    for k in w:
        flat = np.flatnonzero(np.abs(g[k]).reshape(-1) > 1e-5)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            v = {a: b.copy() for a, b in w.items()}
            v[k].reshape(-1)[i] += 1e-5
            up = loss(v)
            v[k].reshape(-1)[i] -= 2e-5
            assert g[k].reshape(-1)[i] == pytest.approx((up - loss(v)) / 2e-5, rel=1e-3, abs=1e-7)


def test_unseen_layouts(weights):
    made = html.training_pages(200, seed=77)
    got = html.label(weights, [html.blocks(p) for p, _ in made], html.WordSlots())
    wrong = sum(int(((p >= 0.5) != np.array(f)).sum()) for p, (_, f) in zip(got, made))
    assert wrong / sum(len(f) for _, f in made) < 0.01


def test_pages_are_whole_and_order_of_batches_does_not_matter(spark, weights):
    words = "So it went on, and nobody knew why."
    article = "".join(f"<p>{i} {words}</p>" for i in range(3000))
    page = f'<body><nav><a href="/">Home</a></nav><article><h1>Title</h1>{article}</article><footer>&copy; 2020</footer></body>'
    rows = [(1, "u", None, "x", 0), (2, "u", "", "x", 0), (3, "u", page, "x", 0), (3, "u", page, "x", 0), (None, None, "<p>&am", "x", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = html.extract(pages, weights)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = {(r.page_id, r.text) for r in got.collect()}
    want = " ".join(["Title", *[f"{i} {words}" for i in range(3000)]])
    assert {(1, ""), (2, ""), (3, want)} <= out and got.count() == 5
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert html.extract(pages.limit(0), weights).count() == 0


def test_only_svg_and_math_close_themselves():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<script src='a.js'/>var a=1;</script><p>x</p>") == ["x"]
    assert texts("<style/>p{}</style><p>x</p><title/>t</title>") == ["x"]
    assert texts("<svg/><p>x</p><math/>y") == ["x", "y"]


def test_deep_pages_take_time_in_proportion():
    def took(n):
        page = "<div class=c>" * n + "".join(f"<p>{i}</p></div></b></ul>" for i in range(n))
        began = time.process_time()
        assert len(html.blocks(page)) == n
        return time.process_time() - began

    took(500)
    assert took(16_000) < 16 * max(0.05, took(2_000))


def plain_label(w, page):
    """Every block's probability, number by number."""
    sig = lambda x: 1 / (1 + math.exp(-min(30, max(-30, x))))
    xs = []
    for i, b in enumerate(page):
        ws = re.findall(r"\w+", b.text.lower())
        slots = [crc32(f"w:{x}".encode()) % html.ROWS for x in ws]
        marks = sum(b.text.count(c) for c in ".,;:!?")
        sums = lambda table, at: [sum(float(table[k][j]) for k in at) for j in range(table.shape[1])]
        numbers = [math.log1p(len(ws)) / 4, math.log1p(len(b.text)) / 6, b.linked, marks / (len(ws) + 1), b.tag in ("h1", "h2", "h3"), min(b.depth, 20) / 10, i / len(page), (len(page) - i) / len(page)]
        xs.append(sums(w["path"], b.path) + sums(w["named"], b.named) + [s / max(1, len(ws)) for s in sums(w["words"], slots)] + [float(x) for x in numbers])

    def lstm(seq, d):
        n, h, c, out = html.HIDDEN, [0.0] * html.HIDDEN, [0.0] * html.HIDDEN, []
        wi, u, b = w["w" + d].tolist(), w["u" + d].tolist(), w["b" + d].tolist()
        for x in seq:
            z = [b[j] + sum(a * r[j] for a, r in zip(x, wi)) + sum(a * r[j] for a, r in zip(h, u)) for j in range(4 * n)]
            c = [sig(z[n + j]) * c[j] + sig(z[j]) * math.tanh(z[3 * n + j]) for j in range(n)]
            h = [sig(z[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
            out.append(h)
        return out

    ahead, back = lstm(xs, "f"), lstm(xs[::-1], "b")[::-1]
    return [sig(float(w["bias"][0]) + sum(a * float(v) for a, v in zip(f + r + x, w["out"]))) for f, r, x in zip(ahead, back, xs)]


def test_registered_query_is_the_plain_network(spark, weights, tmp_path):
    made = [p for p, _ in html.training_pages(12, seed=41)] + [None, "", "<p>one", "no markup", "<div>" * 300 + "deep"]
    rows = [(i, f"http://a/{i}", p) for i, p in enumerate(made)] + [(1, "again", made[1])]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op1_html_blocks"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        page = html.blocks(made[r.page_id])
        p = plain_label(weights, page)
        assert p == pytest.approx(html.label(weights, [page], html.WordSlots())[0].tolist(), abs=1e-9)
        assert r.text == " ".join(b.text for b, x in zip(page, p) if x >= 0.5) and r.n_chars == len(r.text)
