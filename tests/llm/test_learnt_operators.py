"""Held-out accuracy of the learnt operators, on generated pages and texts, and the pipeline's stages."""

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from foreign_pages import PAGES
from sigmaframe.llm import html, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- x --><div class="ad">Buy now, really.</div>
<article><h1>A &amp; B&nbsp;title</h1><p><b>First   paragraph of
the story, with words.<br><p>Second one follows here.</p><ul><li>item one<li>item two</ul></article>
<footer>&copy; example.com</footer></body></html>"""


def test_blocks_of_malformed_markup():
    found = html.readable(PAGE)
    assert [b.text for b in found] == ["Home", "News", "Buy now, really.", "A & B title", "First paragraph of the story, with words.", "Second one follows here.", "item one", "item two", "© example.com"]
    assert found[0].linked == len("Home") and "$article" in found[3].path and "^b" not in found[5].path
    assert html.blocks("") == [] and html.readable(None) == []
    assert [b.text for b in html.blocks("a < b <i>c</i>&#x41;<script>x")] == ["a < b cA"]


@pytest.mark.parametrize("page, want", [
    ("<p>Hello one two.</p><script>for(var i=0;i<n;i++){a(i)}</script><p>After script text.</p>", ["Hello one two.", "After script text."]),
    ("<head><script>if(i<n){x}</script></head><body><p>a <b and c</p><p>x < y & z</p>", ["a <b and c", "x < y & z"]),
    ('<p title="a>b">q</p><p class="x>bad</p><p>more</p>', ["q", "bad", "more"]),
    ("1 <b and c", ["1 <b and c"]),
    ("<SCRIPT>a</script >b<style>c", ["b"]),
    ("x <svg><svg></svg>t</svg> y <object>z", ["x y z"]),
    ("u<!-- c --><!doctype html>v<![CDATA[k]]>w <!-- open", ["uvw"]),
])
def test_raw_text_and_stray_brackets(page, want):
    assert [b.text for b in html.blocks(page)] == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a " * 300_000 + ">", '<a "' * 250_000, "<div>x" * 150_000, "<svg>" * 200_000, "<!--" * 250_000, "<" * 1_000_000, "<script>" * 120_000, "<p>x</div>" * 100_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html.blocks(page)
    assert time.time() - began < 15


def test_pages_of_foreign_layouts():
    model = html.Labeller(html.trained())
    right = [html.main_texts(model, [page])[0] == "\n\n".join(want) for page, want in PAGES.values()]
    assert sum(right) >= 9


def test_paths_reach_the_root():
    deep = "<html><body><nav class=menu>" + "<div><span>" * 12 + "text"
    (block,) = html.blocks(deep)
    assert {"^html", "^body", "^nav", "^.menu"} <= set(block.path)


def test_whole_texts_are_measured():
    head = "word " * 60
    _, words, measures = html.vectors([html.Block(head + tail, ["^p"], 0) for tail in ("plain end", "12345 678")])
    assert [len(w) for w in words] == [62, 62] and words[0][-1] != words[1][-1]
    assert measures[0, 9] == 0 and measures[1, 9] > 0


def test_gradients_are_right():
    pages, labels = html.training_set(4, 3)
    model = html.Labeller(seed=1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    y = np.zeros((4, max(map(len, labels))))
    for k, v in enumerate(labels):
        y[k, : len(v)] = v
    _, g = model.gradients(pages, y)
    for name, at in (("fx", (3, 5)), ("bh", (2, 7)), ("out", (4,)), ("f0", (9,))):
        kept, step = model.w[name][at], 1e-3
        losses = []
        for v in (kept + step, kept - step):
            model.w[name][at] = v
            losses.append(model.gradients(pages, y)[0])
        model.w[name][at] = kept
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[name][at], rel=0.1, abs=2e-4)


def test_labeller_on_unseen_layouts():
    model = html.Labeller(html.trained())
    pages, labels = html.training_set(150, 99)
    wrong = sum((((model.probabilities([p])[0] >= 0.5) != (y > 0)).sum()) for p, y in zip(pages, labels))
    assert wrong <= 0.01 * sum(map(len, labels))
    want = "A & B title\n\nFirst paragraph of the story, with words.\n\nSecond one follows here.\n\nitem one\n\nitem two"
    assert html.main_texts(model, [PAGE, None, "", PAGE]) == [want, "", "", want]


def test_given_pages_give_their_articles():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    want = ["\n\n".join(b.text for b in html.readable(p) if "^article" in b.path) for p in pages]
    got = html.main_texts(html.Labeller(html.trained()), pages)
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(pages) > 0


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, "x", ""), (None, "y", "<div>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id != 1} == {""}
    assert html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0


SLURS = ["grumplak", "zonkeril", "fribblox", "snarkwad"]


def corpus(n, seed):
    r = random.Random(seed)
    syllables = ["the", "an", "er", "in", "re", "ti", "on", "es", "st", "or", "al", "it", "le", "ma"]
    rows, labels = [], []
    for k in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(SLURS))
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, marks).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[k].predicted, y) for k, _, y in labels if got[k].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    left = {r.doc_id for r in toxicity.drop_toxic(docs, marks).collect()}
    assert left == {k for k, r in got.items() if not r.predicted}


def test_toxicity_on_given_labels(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.report(docs, marks).where("held_out").join(marks.select("doc_id", "toxic"), "doc_id").collect()
    right = [r.predicted == r.toxic for r in scored]
    caught = [r.predicted for r in scored if r.toxic == 1]
    assert len(scored) > 500 and np.mean(right) >= 0.97 and np.mean(caught) >= 0.8


def test_labels_of_held_out_rows_are_not_learnt(spark):
    import zlib

    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    flipped = [(k, q, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, q, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.report(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "x" * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.report(docs, none).collect()] == [(0.0, 0)] * 3
    assert toxicity.report(docs.where("false"), none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] == sizes[4]  # the smallest labels are too few to learn from
    packed = p.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    again = p.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in again) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)
