"""License scans and benchmark decontamination against plain readings of their definitions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quern.llm import decontaminate, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        if not b:
            continue
        n = min(10, len(b))
        for win in {tuple(b[i : i + n]) for i in range(max(1, len(b) - 9))}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == win:
                    hit.update(range(p, p + n))
                    found.add(item)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()


def cases():
    r = random.Random(3)
    vocab = "alpha beta Gamma délta éps 12 zeta".split()
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(1, say(30)), (2, say(4)), (3, None), (4, "..."), (5, say(10)), (5, say(11)), (6, "one two")]
    docs = [(i, r.choice([say(40), items[0][1][5:90], f"{say(3)}. {items[4][1]}!! {say(2)}", items[1][1].upper(), ""])) for i in range(60)]
    return docs + [(60, None), (61, "One—two one,TWO"), (61, "One—two one,TWO"), (None, items[0][1])], items


def test_hits_equal_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 400):  # one block, and several passes
        rows = decontaminate.decontaminate(d, b, block_bytes=block_bytes).collect()
        got = sorted((str(r.doc_id), r.n_words, sum(h.to_word - h.from_word for h in r.hits), len(r.item_ids), decontaminate.ids_sha256(r.item_ids)) for r in rows)
        assert got == sorted((str(i), *expected_hits(t, items)) for i, t in docs)


def test_hits_point_into_the_original(spark):
    d = spark.createDataFrame([(1, "xx é One,  TWO! yy")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    (row,) = decontaminate.decontaminate(d, b).collect()
    (h,) = row.hits
    assert row.text.encode()[h.from_byte : h.to_byte].decode() == "One,  TWO"


def test_no_benchmark_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.hits, r.item_ids) for r in decontaminate.decontaminate(d, b).collect()] == [(2, [], [])]
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def base(text):
    w, found = words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_equal_brute_force(spark):
    texts = ["", None, "MIT License", "mit mit license, MIT\nLICENSE", "the general public license apache license", "mit licenses", "GNU General Public License general public license", "émit license x-mit license"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_templates_by_diagonals(spark):
    filler = "lorem ipsum dolor sit amet " * 30
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    w = bsd.split()
    texts = {
        0: filler + bsd + " " + filler,
        1: filler + " ".join([*w[:9], "inserted", *w[9:]]),  # a neighbouring diagonal
        2: " ".join([*w[:9], *w[10:]]) + bsd.upper(),  # a word is lost; a second place
        3: filler,
        4: " ".join(w[:5]),  # too little of it
        5: "Licensed under CC BY-NC 4.0.",
    }
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(6)] == ["bsd", "bsd", "bsd", "", "", "cc-by-nc"]
    assert rows[0].score == 1.0 and [(s.from_word, s.to_word) for s in rows[0].spans] == [(150, 150 + len(w))]
    assert 0.8 <= rows[1].score <= 1 and len(rows[2].spans) == 2 and rows[3].score == rows[4].score == 0


def test_spans_are_verified_word_by_word(spark):
    long = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    ws = next(t for label, t in licenses.TEMPLATES if label == "bsd").split()
    texts = {
        **{f"x y {long.format(a)} z": b for a, b in (("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NonCommercial", "cc-by-nc"), ("-NoDerivatives", "cc-by-nd"), ("-NonCommercial-ShareAlike", "cc-by-nc-sa"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd"), ("-NoDerivs", ""))},
        **{f"Licensed under a CC {a} 4.0 license.": f"cc-{a.lower()}" for a in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
        "Released under the permissive MIT License.": "mit",
        "Released under the BSD License.": "",
        "This work is licensed under the GNU Free Documentation License, version 3.": "",
        " ".join(x for w in ws for x in (w, "other")): "",
        " ".join([*ws[:9], *["other"] * 4, *ws[9:]]): "bsd",
    }
    rows = licenses.scan_licenses(spark.createDataFrame(list(texts), "string").toDF("text").withColumn("doc_id", F.col("text"))).collect()
    assert {r.doc_id: r.labels for r in rows} == texts
    assert [round(r.score, 6) for r in rows if "other other" in r.doc_id] == [round(1 - 4 / 21, 6)]


def test_repeated_and_null_keys(spark):
    rows = [(1, "mit license"), (1, "mit license"), (None, "mit license"), (2, " ".join(["Released under the MIT License."] * 3000))]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_base) for r in got) == [("1", 1), ("1", 1), ("2", 3000), ("None", 1)]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_item_ids_of_any_type(spark):
    b = spark.createDataFrame([("gsm-10", "one two"), ("gsm-9", "three"), (None, "four")], "item_id string, text string")
    d = spark.createDataFrame([(1, "Three, one two! four"), (2, "one three")], "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontaminate.decontaminate(d, b).collect()} == {1: ["gsm-10", "gsm-9", None], 2: ["gsm-9"]}


def test_license_texts_in_parts(spark):
    filler = "lorem ipsum under the free software " * 9
    rows = [(i, filler[: 7 * i] + t + " " + filler[: 5 * i] + " ".join([*t.split()[:4], "x", *t.split()[4:]])) for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(0, licenses.TEMPLATES[1][1])] * 3 + [(0, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, licenses.scan_licenses(d).collect()))
    assert len(want) == len(rows) and sum("spans=[Row" in x for x in want) == len(rows) - 2
    for words in (1, 7, 50):
        assert sorted(map(repr, licenses.scan_licenses(d, part_words=words).collect())) == want
