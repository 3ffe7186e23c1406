"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Shards fill the tree in order: ``racks * shards`` to a region, ``shards`` to a rack. A row draws, for
each region, the first arrival of a Poisson process with the region's weight (``-ln(u) / weight``,
``u`` a hash of the row's key and the node); the least draw wins, and the row descends. Inside a node
the arrival belongs to one child, chosen by a hash in proportion to the children's full weights; any other
child's first arrival comes after it by a fresh exponential draw of that child's weight, as such
processes have no memory. So a node's draw is always the least of its children's draws, at every level.

Weights. A region's weight may be any positive number: it stretches all arrivals of the region alike. A
rack or shard has a weight of 0 to 1, the share of its full size: it keeps an arrival if a hash of the
row and the node, its mark, is below the weight, and else waits for one of a thinner process. A shard
that is not there yet has the weight 0. So whatever weight changes, the draws of other subtrees stay as
they are: all rows that move come to be in the node's subtree if it rises, were in it if it falls, and one
more shard takes rows into itself only. A row costs one draw per region in which all is full, and per rack and
shard of the others.

All of it is column expressions, in the JVM. ``slot`` numbers a shard's rows without gaps, in the order
of (key, checksum, size): rows are cut by range over (shard, that order, a number of the row's own), so
neither a large shard nor a row repeated very often is in one task, counted with map-side aggregation, and
numbered within the cuts behind the sum of those before.

Defined cases: a null text counts no bytes and has the checksum of the empty text; a null key is a
key like any other; repeated rows follow one another; a text of any length is only measured; an empty table
gives no rows; only the columns named are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._common import materialise, read

RACKS, SHARDS = 2, 4
ROWS_PER_CUT = 1 << 18


def _u(key: Column, *node) -> Column:
    """A number in (0, 1) from the key and the node: 52 bits of an MD5."""
    digest = F.md5(F.concat(key, F.lit("/" + "/".join(map(str, node)))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _exp(key: Column, weight: float, *node) -> Column:
    return -F.ln(_u(key, *node)) / F.lit(float(weight))


def _least(draws: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(draw, shard) with the smallest draw; the first of equal ones."""
    if len(draws) == 1:
        return draws[0]
    best = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("i"), s.alias("shard")) for i, (d, s) in enumerate(draws)]))
    return best["draw"], best["shard"]


def _child(key: Column, n: int, *node) -> Column:
    """The child, of n equal ones, that a node's draw belongs to."""
    return F.floor(_u(key, "pick", *node) * n).cast("int")


def shard_of(key: Column, n: int, *, racks: int = RACKS, shards: int = SHARDS, weights: dict[tuple[int, ...], float] | None = None) -> Column:
    """The shard, 0 to n - 1, of a string key, among n shards. ``weights`` of nodes by their places, each from 0 in
    its parent: (region,), (region, rack) and (region, rack, shard); others have the weight 1."""
    if n < 1:
        raise ValueError("there must be a shard")
    weights = weights or {}
    if bad := [k for k, w in weights.items() if not (0 < w < float("inf") if len(k) == 1 else 0 <= w <= 1)]:
        raise ValueError(f"a region's weight is positive, a rack's and a shard's 0 to 1: {bad[0]}")
    each, draws = racks * shards, []
    for r in range(-(-n // each)):
        # of each rack, the weights of its shards
        tree = [[(r * each + k * shards + s < n) * weights.get((r, k), 1.0) * weights.get((r, k, s), 1.0) for s in range(shards)] for k in range(racks)]
        draws += _region(key, r, tree, weights.get((r,), 1.0))
    if not draws:
        raise ValueError("all shards have the weight 0")
    return _least(draws)[1].cast("int")


def _region(key: Column, r: int, tree: list[list[float]], weight: float) -> list[tuple[Column, Column]]:
    """Draws of the region's racks and shards, or the one of a region that is full."""
    racks, shards = len(tree), len(tree[0])
    first = r * racks * shards
    top, rack = _exp(key, racks * shards * weight, "g", r), _child(key, racks, "g", r)
    pick = [_child(key, shards, "g", r, k) for k in range(racks)]
    if all(w == 1 for own in tree for w in own):
        return [(top, F.coalesce(*[F.when(rack == k, F.lit(first + k * shards) + pick[k]) for k in range(racks)]))]
    draws = []
    for k, own in enumerate(tree):
        draw, base = F.when(rack == k, top).otherwise(top + _exp(key, shards * weight, "k", r, k)), first + k * shards
        if all(w == 1 for w in own):
            draws.append((draw, F.lit(base) + pick[k]))
            continue
        for s, w in enumerate(own):
            if w:
                mine = (pick[k] == s) if w == 1 else (pick[k] == s) & (_u(key, "mark", r, k, s) < w)
                draws.append((F.when(mine, draw).otherwise(draw + _exp(key, w * weight, "s", r, k, s)), F.lit(base + s)))
    return draws


def with_slots(rows: DataFrame, shard: str, order: list[str], *, rows_per_cut: int = ROWS_PER_CUT) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each shard, by ``order``; wholly equal rows in any order."""
    rows = materialise(rows.withColumn("_own", F.monotonically_increasing_id()))
    cuts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // rows_per_cut)
    rows = materialise(rows.repartitionByRange(cuts, shard, *order, "_own").withColumn("_cut", F.spark_partition_id()))
    counts = rows.groupBy(shard, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(shard).alias("_shard"), F.col("_cut").alias("_of"), F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_cut", shard).orderBy(*order, "_own")))
    return numbered.join(before, (F.col(shard) == F.col("_shard")) & (F.col("_cut") == F.col("_of"))).withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_cut", "_at", "_own", "_shard", "_of", "_before")


def shard_rows(docs: DataFrame, n: int, *, key: str = "doc_id", text: str = "text", racks: int = RACKS, shards: int = SHARDS, weights: dict[tuple[int, ...], float] | None = None, rows_per_cut: int = ROWS_PER_CUT) -> DataFrame:
    """Per row: the key, ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``law`` (``key``), ``shard`` among n, ``slot``, ``grown_shard`` among n + 1."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(own, n, racks=racks, shards=shards, weights=weights).alias("shard"),
        shard_of(own, n + 1, racks=racks, shards=shards, weights=weights).alias("grown_shard"),
    )
    return with_slots(rows, "shard", [key, "text_crc32", "size"], rows_per_cut=rows_per_cut)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"), 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _oracle(n_name: str, n: int, racks: int = RACKS, shards: int = SHARDS) -> str:
    """SQL for one row's shard among n: the same draws, as a list of (draw, place, shard) with the least first."""
    each = racks * shards
    full, rest = divmod(n, each)
    u = lambda *node: f"((CAST('0x' || substr(md5(k || '/{'/'.join(map(str, node))}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    exp = lambda w, *node: f"(-ln({u(*node)}) / {float(w)}::DOUBLE)"
    child = lambda c, *node: f"CAST(floor({u('pick', *node)} * {c}) AS INTEGER)"
    draws = []
    for r in range(full):
        inner = " ".join(f"WHEN {k} THEN {r * each + k * shards} + {child(shards, 'g', r, k)}" for k in range(racks))
        draws.append((exp(each, "g", r), f"CASE {child(racks, 'g', r)} {inner} END"))
    if rest:
        top, pick = exp(each, "g", full), child(racks, "g", full)
        for k in range(-(-rest // shards)):
            draw = f"CASE WHEN {pick} = {k} THEN {top} ELSE {top} + {exp(shards, 'k', full, k)} END"
            base, own = full * each + k * shards, child(shards, "g", full, k)
            if rest >= (k + 1) * shards:
                draws.append((draw, f"{base} + {own}"))
            else:
                draws += [(f"CASE WHEN {own} = {s} THEN {draw} ELSE {draw} + {exp(1, 's', full, k, s)} END", str(base + s)) for s in range(rest - k * shards)]
    rows = ", ".join(f"{{'d': {d}, 'i': {i}, 's': {s}}}" for i, (d, s) in enumerate(draws))
    return f"CAST(list_sort([{rows}])[1].s AS INTEGER) AS {n_name}"


#: CRC-32 of the text's bytes, byte by byte through the usual table, as DuckDB has no such function.
_CRC = """(SELECT list(CAST(t AS BIGINT)) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) r(i) ORDER BY i))"""
OP3_SQL = f"""
WITH tbl AS (SELECT {_CRC} AS t),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, k, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
             lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) + 1 AS BIGINT)])), 4294967295) AS text_crc32
  FROM d, tbl),
s AS (SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, {_oracle('shard', 40)}, {_oracle('grown_shard', 41)} FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM s
"""
