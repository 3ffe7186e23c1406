import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import neighbours, warc

PAGE = "<html>" + "x" * 1200


def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:quern:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
    return [(1, PAGE), (5, PAGE), (3, PAGE), (None, PAGE), (2, "short"), (4, "short"), (6, None), (7, ""), (8, fake * 40), (9, "é\r\n\r\n " * 300), (10, "WARC/1.1"), (11, PAGE + "y"), (11, PAGE + "y")]


def test_round_trip(spark, tmp_path):
    d = spark.createDataFrame(pages(), "page_id long, html string").withColumn("url", F.lit("http://x/ y\n"))
    path = warc.write_warc(d.repartition(2), str(tmp_path / "w"), archive_bytes=1 << 17)
    got = sorted((str(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect())
    want = []
    for k, html in pages():
        raw = (html or "").encode()
        again = html == PAGE and k != 5
        want.append((str(k), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want)


def test_urls_of_any_length(spark, tmp_path):
    urls = {1: "data:text/html," + "x" * 100_000, 2: "http://x/" + "WARC/1.1\r\n: " * 20_000, 3: None}
    d = spark.createDataFrame([(k, u, f"text {k}" * 300) for k, u in urls.items()], "page_id long, url string, html string")
    path = warc.write_warc(d.coalesce(1), str(tmp_path / "w"))
    assert sorted(r.id for r in warc.read_warc(spark, path).collect()) == [1, 2, 3]


def test_many_headers_with_one_end():
    line, tail = b"X: WARC/1.1\r\n", b"Content-Length: 3\r\nWARC-Record-ID: <urn:quern:5>\r\n\r\nabc\r\n\r\n"
    data = b"WARC/1.1\r\nContent-Length: 9\r\n" + line * 50_000 + tail + b"WARC/1.1\r\n\r\n" + line * 50_000
    found = warc.candidates(data)
    end = len(line) * 50_000 + len(b"WARC/1.1\r\nContent-Length: 9\r\n" + tail)
    assert len(found) == 50_001 and {x[1:3] for x in found} == {(end, 5)} and found[0][0] == 0
    assert warc.candidates(line + b"Content-Length: 9\r\nWARC/1.1\r\nX: y\r\n\r\n")[0][0] == 3 and len(warc.candidates(line + b"Content-Length: 9\r\nWARC/1.1\r\nX: y\r\n\r\n")) == 1


def test_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(d, str(tmp_path / "w"))).count() == 0


def test_broken_chains_are_errors(spark, tmp_path):
    d = spark.createDataFrame([(i, "text %d" % i) for i in range(9)], "page_id long, html string")
    path = warc.write_warc(d.coalesce(1), str(tmp_path / "w"), url=None)
    file = next((tmp_path / "w").glob("part-*"))
    whole = file.read_bytes()
    (tmp_path / "w" / f".{file.name}.crc").unlink()
    for broken, what in ((whole[:-3], "chain"), (b"junk" + whole, "chain"), (whole.replace(b"text 4", b"text X"), "contradicts")):
        file.write_bytes(broken)
        with pytest.raises(Exception, match=what):
            warc.read_warc(spark, path).collect()


def test_pointer_jumping_equals_walking():
    r = np.random.default_rng(3)
    for _ in range(200):
        offsets = np.unique(np.append(0, r.integers(1, 300, 40)))
        successors = np.array([r.choice(offsets[offsets > o]) if (offsets > o).any() and r.random() < 0.9 else 1000 + o for o in offsets])
        seen, at = set(), 0
        while at in set(offsets.tolist()):
            seen.add(at)
            at = int(successors[np.searchsorted(offsets, at)])
        assert set(offsets[warc.reachable(offsets, successors)].tolist()) == seen


def test_nearest_equal_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 5))
    x = [(i, [float(np.float32(v)) for v in base[i % 6] * r.choice([1, 1.0001, 50]) + r.normal(size=5) * r.choice([0, 1e-3])]) for i in range(400)]
    x += [(500, None), (600, [0.0] * 5), (700, [1.0, None, 1.0, 1.0, 1.0]), (800, [float("nan")] * 5), (900, [float("inf")] * 5), (1000, []), (None, [1.0] * 5), (1100, [1.0] * 3), (1101, [2.0, 1.0, 1.0]), (42, x[42][1])]
    d = spark.createDataFrame(x, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash"))
    valid = [(k, np.array(v, np.float64)) for k, v in x if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = {}
    for i, (q, a) in enumerate(valid):
        if q % 100 == 0:
            near = sorted((float(neighbours.distances(b[None, :].astype(np.float32).astype(float), a.astype(np.float32).astype(float))[0]), k) for j, (k, b) in enumerate(valid) if j != i and len(b) == len(a))[:10]
            want[q] = [(n + 1, k, s) for n, (s, k) in enumerate(near)]
    for rows, queries in ((8192, 4096), (7, 2)):
        got = {}
        for r_ in neighbours.nearest(d, F.col("vec_id") % 100 == 0, rows=rows, queries=queries).collect():
            got.setdefault(r_.query_id, []).append((r_["rank"], r_.vec_id, r_.score))
        assert {k: sorted(v) for k, v in got.items()} == want
    assert neighbours.nearest(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 1500)) * np.exp(r.normal(size=(300, 1)) * 3)
    q, s, e = neighbours.quantised(x)
    assert np.array_equal(neighbours.product(q, q), q.astype(np.int64) @ q.astype(np.int64).T)
    near = np.sqrt(((x[:, None, :5] - x[None, :, :5]) ** 2).sum(axis=2))
    got = np.sqrt((((q * s[:, None])[:, None, :5] - (q * s[:, None])[None, :, :5]) ** 2).sum(axis=2))
    assert (np.abs(near - got) <= e[:, None] + e[None, :] + 1e-9).all()


def test_repeated_queries_are_one_another_s_nearest(spark):
    x = [(100, [1.0, 0.0])] * 13 + [(100, [1.0, 0.5]), (7, [1.0, 0.0]), (200, [-0.0, 2.0]), (200, [0.0, 2.0]), (300, [5.0])]
    d = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    for queries in (None, 1):
        got = neighbours.nearest(d, F.col("vec_id") % 100 == 0, queries=queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
        near = {r.query_id: [tuple(x) for x in r.near] for r in got.collect()}
        # thirteen equal rows: one nearest is 7, then nine of the others; the fourteenth has them at 0.5
        ten = [(1, 7, 0.0)] + [(i, 100, 0.0) for i in range(2, 11)]
        far = [(1, 7, 0.5)] + [(i, 100, 0.5) for i in range(2, 11)]
        assert near[100] == sorted(ten * 13 + far)
        assert [n for n in near[200] if n[0] == 1] == [(1, 200, 0.0)] * 2
        assert 300 not in near
