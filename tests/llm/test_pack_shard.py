import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import pack, shard


def test_words_encode_as_the_tokenizer_does():
    w = pack.WordTokenizer(pack.default_tokenizer(), cached=500)
    r = random.Random(1)
    pools = ["abcXYZ 0129 '’.,!?-_*#<|>\t\n", "éèÉßÄöñ İıΣσς ǅ", "́̈ \xad ​\xa0　﻿᠎\x1c\x85", "汉字 кириЛЛица 😀👍🏽 ½²Ⅷ ﬁ ＡＢ", "it's we'll I'D <|endoftext|> <|STARTOFTEXT|>"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += [f"{chr(i)}a{chr(i)} b{chr(i)}B" for i in range(1, 0x3000)] + [" ".join(f"w{i}x" for i in range(2000))]
    for text, ids in zip(texts, w.encode([t.encode() for t in texts]), strict=True):
        assert np.array_equal(ids, w.whole(text)), text


def test_pieces_are_the_documents_ids(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "tion " * 5000), (5, "a " * 2047), (6, "a " * 2048), (1, "hello world"), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack.pieces_of(d).collect()
    w = pack.tokenizer_of(pack.default_tokenizer())
    by = defaultdict(list)
    for p in got:
        by[p.doc_id].append(p)
    for key, text in dict(rows).items():
        ids = [*w.whole(text or "").tolist(), 0]
        own = sorted(by[key], key=lambda p: p.piece)[:: 2 if key == 1 else 1]
        assert [x for p in own for x in p.ids] == ids
        assert [(p.piece, p.start, p.length) for p in own] == [(i, 2048 * i, min(2048, len(ids) - 2048 * i)) for i in range(-(-len(ids) // 2048))]
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)
    assert sorted(len(by[k]) for k in (5, 6)) == [1, 2]


def filled(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


@pytest.mark.parametrize("per_packer", [100, 100000])
def test_packing_is_gapless_and_tight(spark, per_packer):
    r = random.Random(2)
    sizes = [r.choice([2048, r.randint(1, 2048), r.randint(1, 300)]) for _ in range(3000)]
    p = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack.pack(p, pieces_per_packer=per_packer).collect()
    assert sorted(x.doc_id for x in rows) == list(range(3000))
    assert filled(rows) <= 1.02 * -(-sum(sizes) // 2048) + 2
    assert pack.pack(p.limit(0)).count() == 0


def test_best_fit_takes_the_fullest_and_bounds_open_bins():
    fit = pack.BestFit(10, 2)
    assert fit.put(6) == (0, 0) and fit.put(7) == (1, 0) and fit.put(3) == (1, 7)  # bin 1 fits it best
    assert fit.put(8) == (2, 0) and fit.open == 2
    assert fit.put(9) == (3, 0) and 2 in fit.closed and fit.open == 2  # the fullest closed
    assert fit.put(4) == (0, 6)


def test_shards_hold_the_law(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    cols = [n for n in (*range(1, 19), 39, 40, 41)]
    rows = keys.select("k", *[shard.shard_of(F.col("k"), n).alias(f"n{n}") for n in cols]).collect()
    for n in cols:
        counts = np.bincount([r[f"n{n}"] for r in rows], minlength=n)
        assert len(counts) == n and abs(counts - 20000 / n).max() < 6 * (20000 / n) ** 0.5
        if n + 1 in cols:
            moved = {r[f"n{n + 1}"] for r in rows if r[f"n{n + 1}"] != r[f"n{n}"]}
            assert moved == {n}


@pytest.mark.parametrize("per_cut", [50, 1 << 18])
def test_slots_are_gapless(spark, per_cut):
    rows = [(i % 400, "x" * (i % 7)) for i in range(1000)] + [(None, None), (5, None), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = shard.shard_rows(d, 40, rows_per_cut=per_cut).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(16, 0)}
    for r, n in zip(sorted(got, key=lambda r: (r.shard, r.slot)), sorted(got, key=lambda r: (r.shard, r.doc_id is not None, r.doc_id, r.text_crc32, r.size)), strict=True):
        assert (r.doc_id, r.text_crc32) == (n.doc_id, n.text_crc32)
    assert shard.shard_rows(d.limit(0), 40).count() == 0


def test_equal_rows_are_spread(spark):
    same = spark.range(20000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shard.shard_rows(same, 40, rows_per_cut=1000)
    assert sorted(r.slot for r in got.select("slot").collect()) == list(range(20000))
    p = spark.range(20000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "30L AS length", "1L AS ids_crc32")
    sizes = pack._packed(pack.materialise(p), 8, 2048, 512, 0).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 3500
    assert filled(pack.pack(p, pieces_per_packer=3000).collect()) <= 1.02 * 20000 / 68 + 2


def test_weights_move_rows_only_in_their_subtree(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    base = {(1,): 2.0, (2, 0): 0.5, (3, 1, 2): 0.25}
    changes = {(1,): (2.0, 3.0), (0,): (1, 0.5), (2, 0): (0.5, 0.9), (4, 1): (1, 0.0), (3, 1, 2): (0.25, 1.0), (0, 0, 0): (1, 0.5), (2, 0, 1): (1, 0.0)}
    of = lambda w, n=40: shard.shard_of(F.col("k"), n, weights=w)
    rows = keys.select("k", of(base).alias("base"), of(base, 41).alias("grown"), *[of(base | {node: w}).alias(str(i)) for i, (node, (_, w)) in enumerate(changes.items())]).collect()
    share = [2 if s // 8 == 1 else (0.5 if s // 4 == 4 else 0.25 if s == 3 * 8 + 6 else 1) for s in range(40)]
    counts = np.bincount([r.base for r in rows], minlength=40)
    expected = 20000 * np.array(share) / sum(share)
    assert abs(counts - expected).max() < 6 * expected.max() ** 0.5
    assert {r.grown for r in rows if r.grown != r.base} == {40}
    for i, (node, (old, new)) in enumerate(changes.items()):
        inside = lambda s: (s // 8, s // 4 % 2, s % 4)[: len(node)] == node  # noqa: B023, E731
        moved = [(r.base, r[str(i)]) for r in rows if r.base != r[str(i)]]
        assert moved
        for a, b in moved:
            assert inside(b) if new > old else inside(a)
    with pytest.raises(ValueError, match="weight"):
        of({(0, 1): 2.0})
