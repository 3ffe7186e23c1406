"""The pipeline against plain readings of its stages, and the registered queries."""

import random
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_dedup import brute
from test_scans import expected_hits

from quern.llm import pack, toxicity


def tables(spark, folder):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 12, 10, 4])] + [(9, None)]
    docs = []
    for i in range(240):
        text = say(r.choice([0, 2, 6, 40, 90]))
        docs.append((i, text + " you vile wretch" if i % 6 == 0 else text))
    docs += [(300 + i, docs[30 + i][1]) for i in range(20)] + [(330 + i, docs[60 + i][1] + " more") for i in range(20)]
    docs += [(400 + i, f"{say(8)}, {items[i % 4][1].upper()}! {say(3)}") for i in range(12)] + [(500, None), (501, ""), (502, say(9000)), (None, say(30)), (7, docs[7][1]), (7, docs[7][1])]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240) if i % 5] + [(5, None, None), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "cast(length(text) AS long) AS n_chars")
    d.withColumn("row", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path / "sf")
    docs, items = tables(spark, folder)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = [d for d in docs if model.score(None if d[1] is None else d[1].encode()) < 0.5]
    assert clean == [d for d in docs if "vile wretch" not in (d[1] or "")]  # all the toxic and no other
    kept, seen = [], set()
    for (key, _, component), (k, text) in zip(brute(clean, 80), sorted(clean, key=lambda d: str(d[0])), strict=True):
        # rows that repeat the kept key are one another's copies: one of them stays
        if key == component and (key not in seen or not text):
            seen.add(key)
            kept.append((k, text))
    want = Counter((k, t) for k, t in kept if not expected_hits(t, items)[1])
    w = pack.tokenizer_of(pack.default_tokenizer())
    pieces = Counter((k, i, min(2048, n - 2048 * i)) for (k, t), times in want.items() for n in [len(w.whole(t or "")) + 1] for i in range(-(-n // 2048)) for _ in range(times))
    got = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == pieces
    bins: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "sf")
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == list(pipeline.COLUMNS) and out.count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
