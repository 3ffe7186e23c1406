"""Toxicity, HTML extraction and chat repair."""

import re
from html import unescape
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, html, toxicity

DATA = "/root/testdata/sf0.01"


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels)
    rows = toxicity.score(d.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))), model).select("toxic", "score", "predicted").collect()
    y, s, p = (np.array([r[i] for r in rows]) for i in range(3))
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert auc > 0.93 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.02
    assert model.score(None) == model.score(b"") < 0.5


def test_scores_do_not_depend_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(d, labels), toxicity.train(d, turned)
    assert a.weights == b.weights and a.bias == b.bias


def test_toxicity_without_anything_to_learn(spark):
    d = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.train(d, labels)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 3
    assert toxicity.train(d.limit(0), labels.limit(0)).weights == {}


def test_labels_of_absent_documents_take_no_places(spark):
    docs = [(i, "vile awful words" if i % 4 == 0 else f"fine words {i % 7}") for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    present = [(i, int(i % 4 == 0)) for i in range(200)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    args = {"prior": 0.25, "positives": 30, "unlabelled": 120}
    a = toxicity.train(d, make(present), **args)
    b = toxicity.train(d, make(present + [(i, 1) for i in range(1000, 9000)]), **args)
    assert a.weights == b.weights and a.bias == b.bias and b.score(b"vile awful") > b.score(b"fine words")


def test_risk_is_corrected_for_the_prior():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.3
    x = np.where(truth, r.random(4000) < 0.8, r.random(4000) < 0.05)
    positive = np.concatenate([np.ones(500, bool), np.zeros(4000, bool)])
    has = np.concatenate([r.random(500) < 0.8, x])
    w, b = toxicity.fit(np.flatnonzero(has), np.zeros(int(has.sum()), int), positive, 1, 0.3)
    assert b < 0 < b + w[0]  # though U is 30 % positive, it isn't taken for negative


def test_features_bound_the_prior():
    r = np.random.default_rng(2)
    for true in (0.02, 0.1, 0.4):
        n_p, n_u = 2000, 12000
        toxic = r.random(n_u) < true
        shares = [((r.random(n_p) < q).mean(), (r.random(n_u) < np.where(toxic, q, base)).mean()) for q, base in zip(r.random(500), r.random(500) * 0.3, strict=True)]
        assert true <= toxicity.greatest_prior(shares, n_p, n_u)
        alone = [((r.random(n_p) < 0.7).mean(), (toxic & (r.random(n_u) < 0.7)).mean())]
        assert true <= toxicity.greatest_prior([*shares, *alone], n_p, n_u) < 1.35 * true + 0.01
    assert toxicity.greatest_prior([], 10, 10) == toxicity.greatest_prior([(0.5, 0.0)], 3, 9) == 1.0


def article(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(unescape(re.sub(r"<(?:p|/p|br|h1|/h1|li|/li|ul|/ul)>", " ", body).replace("<b>", "").replace("</b>", "")).split())


def test_articles_of_whole_pages():
    rows = __import__("pyarrow.parquet").parquet.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    whole = [p for p in rows if "</article>" in p]
    field = html.default_field()
    same = [field.extract(p) == article(p) for p in whole]
    assert len(whole) > 200 and np.mean(same) > 0.99


def test_held_out_layouts():
    field, right, n = html.default_field(), 0, 0
    for page in html.labelled_pages(150, seed=99):
        blocks = html.blocks_of(page)
        for b, main in zip(blocks, field.decode(blocks), strict=True):
            right, n = right + (main == (b.label == "1")), n + 1
    assert right / n > 0.97


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(3)
    for n in range(1, 7):
        blocks = [html.Block(f"some words {i}.", frozenset({f"in:{i}"}), "p") for i in range(n)]
        f = html.Field({f"in:{i}": float(r.normal()) for i in range(n)}, r.normal(size=(2, 2)), r.normal(size=2))
        total = lambda y: f.start[y[0]] + sum(f.weights[f"in:{i}"] * v for i, v in enumerate(y)) + sum(f.between[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert f.decode(blocks) == [bool(v) for v in max(product((0, 1), repeat=n), key=total)]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (None, []),
        ("", []),
        ("plain &lt;b&gt; text &am &copy;", ["plain <b> text &am ©"]),
        ("<p>a<b>b</b> c<br>d\n e<p>f", ["ab c d e", "f"]),
        ("<script>x</p>y</script><style>z</style><!-- <p>q --><p title='a>b'>t</p>", ["t"]),
        ("<ul><li>a<li>b</ul><p>c<scr", ["a", "b", "c"]),
        ("<div>a</span></p>b<script>rest <p>of it", ["ab"][:0] + ["a", "b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>" * 2000 + "deep", ["deep"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in html.blocks_of(page or "")] == texts


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        *((f'<article><p>a</p><{tag} width="1"/><p>b</p></article><{tag}>x</{tag}><p>c', ["a", "b", *x, "c"]) for tag, x in (("svg", ["x"]), ("math", ["x"]), ("object", ["x"]), ("iframe", []), ("template", []), ("title", []), ("script", []))),
        *((f"<article><{tag} class=icon><p>a</p></article><p>b", ["a", "b"]) for tag in ("svg", "math", "object", "xmp", "iframe", "noframes", "template")),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg><path d='M0'/></svg>so.</p><object data=a><p>c</p></object><xmp>d</xmp>", ["Let x=1 be so.", "c", "d"]),
        ("<svg><title>icon</title><text>a</text><text>b</text></svg>", ["a", "b"]),
        ("<title-bar>a</title-bar><p>b<script src='/x/'>y</script-x></script>c", ["a", "bc"]),
        ("<iframe src=/a/b.html>x</iframe><p>a<template><b>y</b></template><noframes>", ["a"]),
        ("<p>a<textarea>rest <p>of it", ["a"]),
    ],
)
def test_only_what_is_not_shown_is_left_out(page, texts):
    assert [b.text for b in html.blocks_of(page)] == texts


@pytest.mark.parametrize("n", [600, 20_000])
def test_elements_at_any_depth(n):
    text = "It is a text of some words, it is."
    for tag in ("div", "font", "x-y"):
        page = f"<{tag}><article>{f'<{tag}>' * n}<p>{text}</p>{f'</{tag}>' * n}<p>{text}</p></article><footer><p>&copy; x</p></footer></{tag}>"
        assert [("in:article" in b.path, "in:footer" in b.path) for b in html.blocks_of(page)] == [(True, False)] * 2 + [(False, True)]
        assert html.default_field().extract(page) == f"{text} {text}"
    (aside,) = html.blocks_of("<div>" * n + "<aside class=comments>x</aside>")
    assert {"in:aside", "kind:talk"} <= aside.path and aside.tag == "aside"
    many = html.blocks_of("".join(f"<x{i}><p>y" for i in range(n)) + "</z><div>")
    assert len(many) == n and all(len(b.path) < 5 for b in many)


def test_article_after_a_self_closed_icon():
    text = "It is a text of some words, it is."
    for icon in ('<svg width="1"/>', "<svg width='1'>", "<object data='a'>", "<math/>"):
        assert html.default_field().extract(f"<article><p>{icon}{text}</p><p>{text}</p></article><footer>&copy; x</footer>") == f"{text} {text}"


def test_extract_table(spark):
    p = spark.createDataFrame([(1, None), (1, None), (2, "<article><p>It is a text of some words, it is.</p></article><footer>&copy; x</footer>")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = html.extract(p).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "", 0), (1, "", 0), (2, "It is a text of some words, it is.", 34)]
    assert html.extract(p.limit(0)).count() == 0


def legal(states):
    return all(b in chat.LEGAL[a] for a, b in zip([0, *states], states, strict=False))


def cheapest(roles):
    """Least cost by trying every way to label, merge and insert, a turn at a time."""
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            for target in (1, 2, 3):
                changed = chat.RELABEL * (target != role)
                ways = [cost + changed + chat.MERGE] if target == state else []
                for n in range(4):
                    for chain in product((1, 2, 3), repeat=n):
                        if all(b in chat.LEGAL[a] for a, b in zip((state, *chain), (*chain, target), strict=True)):
                            ways.append(cost + changed + chat.INSERT * n)
                if ways:
                    after[target] = min(ways + [after.get(target, chat.FAR)])
        best = after
    return min(best.values())


def test_repairs_are_legal_and_cheapest():
    for n in range(1, 6):
        for roles in product(range(4), repeat=n):
            path = chat.settle(list(roles))
            states = [s for state, step in path for s in [*step[1], *([] if step[2] else [state])]]
            assert legal(states) and sum(step[0] for _, step in path) == cheapest(roles)


def test_conversations_across_partitions(spark):
    r = np.random.default_rng(2)
    names = ["user", "assistant", "system", "Human", "gpt", None, "tool"]
    rows = [(c, t, names[r.integers(7)], f"c{c}t{t} <|im_end|>") for c in range(12) for t in range(int(r.integers(1, 6)))] + [(99, t, names[r.integers(7)], "x") for t in range(400)] + [(None, None, None, None), (3, 0, "user", "again"), (3, 0, "user", "again")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash"))
    got = chat.repair(d)
    held = got.collect()
    assert len(held) == len(rows)
    for c in {x[0] for x in rows}:
        own = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1], x[2] is not None, x[2] or "", x[3] or ""))
        mine = [x for x in held if x.conv_id == c]
        assert sum(x.cost for x in mine) == cheapest([chat.role_of(x[2]) for x in own])
        text = "".join(x.fragment for x in mine)
        assert text.count(chat.OPEN) == text.count("<|im_end|>") and text.endswith(chat.CLOSE)
        states = [chat.role_of(x) for x in re.findall(r"<\|im_start\|>(\w+)", text)]
        assert legal(states)
    texts = {x.conv_id: x.text for x in chat.render(d).collect()}
    assert texts[99] == "".join(x.fragment for x in held if x.conv_id == 99)
    assert chat.repair(d.limit(0)).count() == 0
