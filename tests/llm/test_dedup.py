import random
import re

import numpy as np
from pyspark.sql import functions as F

from quern.llm import dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        ids[r] = min((x for x in (ids.get(r), k) if x is not None), default=None)
    return sorted((str(k), len(s), str(k if not s else ids[find(i)])) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(n=40, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    rows, key = [], 0
    for _ in range(n):
        text = [word() for _ in range(r.choice([1, 3, 5, 6, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            own = list(text)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = word()
            rows.append((key, r.choice(["  ", " ", "\n"]).join(own)))
            key += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \t"), (None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1])]


def test_components_equal_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    for percent, tile, shingles in ((85, 1024, 1 << 20), (80, 3, 1 << 20), (80, 1024, 300)):  # tiles smaller than the groups
        got = dedup.near_duplicates(d, percent=percent, tile=tile, tile_shingles=shingles).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert dedup.near_duplicates(d.limit(0)).count() == 0


def test_many_copies_and_a_chain(spark):
    r = random.Random(1)
    text = [f"w{i}" for i in range(120)]
    chain = [(i, " ".join([f"x{j}" for j in range(i)] + text[i:])) for i in range(0, 24)]  # neighbours alike, ends not
    rows = chain + [(1000 + i, "same words in every one of these texts") for i in range(300)]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(24)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    for size in (1, 8, 100, 1000):
        for shared in (0, size // 2, size):
            sets = [np.unique(pool[:size]), np.unique(np.concatenate([pool[:shared], pool[1000 : 1000 + size - shared]]))]
            sig = dedup.superminhash(sets, 140)
            assert np.isfinite(sig).all() and (np.sort(np.floor(sig), axis=1) >= 0).all()
            true = shared / (2 * size - shared)
            assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    assert np.isinf(dedup.superminhash([np.empty(0, np.uint64)], 140)).all()


def test_long_texts_are_hashed_in_parts(monkeypatch):
    line = b" ".join(b"w%d" % (i % 977) for i in range(5000))
    whole = dedup.sets_of([line, b"a b", b""])
    monkeypatch.setattr("quern.llm._words.PART_BYTES", 3000)
    parts = dedup.sets_of([line, b"a b", b""])
    assert len(whole[0]) == 977 and [len(x) for x in whole] == [977, 1, 0]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
