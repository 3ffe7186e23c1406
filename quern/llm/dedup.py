"""Near-duplicate detection by SuperMinHash signatures, banding, verification and union-find.

A document's set is its distinct shingles of ``shingle`` words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased); a
document of fewer words has its whole sequence as the one shingle; without words the set is empty and
the document is linked with nothing. Two sets are linked if ``100 * intersection >= percent * union``,
which is confirmed on the full sets (of 64-bit shingle hashes). Documents with equal sets are one node.

Signatures: in step j every shingle offers the value j + r (r in [0, 1)) to the j-th place of its own
random permutation of the registers, and a document stops as soon as all its registers are below
j + 1, after which no offer can win. All documents of a slice take a step together in numpy.

Plan
1. One pass over the texts gives each row its set size, node (128-bit digest of the set) and band keys;
   this slim table is checkpointed. Nodes merge equal sets, however many rows hold them, with
   map-side aggregation.
2. Buckets are (band, key) with two nodes or more. Of buckets with the same members, told by two
   hashes summed map-side, one is kept.
3. Sets of the nodes in kept buckets are computed from one row's text each, and each bucket is
   resolved in a task: all intersections by matrix products over the shared shingles, then a spanning
   forest of the confirmed links. A bucket of more than ``tile`` nodes, or of more than ``tile_shingles``
   shingles, is first dealt at random into chunks that are resolved alone; then a representative of
   each component found, dealt again; last, members that still have different roots are compared, a
   pair of chunks to a task. So a large group of near copies, which soon hang together, costs in
   proportion to its size, no task grows with a group or with long texts, and no link is lost.
4. The forests' edges, fewer than nodes per bucket, become components by large-star and small-star
   steps as joins and map-side minima, with a checkpoint each.

Banding finds a pair of similarity s with probability 1 - (1 - s^rows)^bands: for 5 rows and 28 bands
0.99998 at 0.8 and 0.9999999 at 0.85. What is found is confirmed exactly.

Defined cases: null and empty texts have an empty set and are their own component; rows with a null
key take part, but a component's id is its smallest key that is not null (null if there is none, and
then its rows are all kept); repeated rows share a node and so a component, and rows that repeat the
kept key are all kept; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import arrow_type, binaries, map_slices, materialise, read
from quern.llm._words import LOWER, gram_hashes, mix

SHINGLE = 5
ROWS, BANDS = 5, 28
TILE, TILE_SHINGLES = 1024, 1 << 19
#: Rounds in which representatives of large buckets' components are compared, before all their members are.
ROUNDS = 2
#: Candidate keys that are broadcast when texts are fetched again (16 bytes each); above, the tables are joined by a shuffle.
BROADCAST_KEYS = 1 << 19
#: Bytes of text sketched at once: each shingle may need a permutation of the registers for a while.
SKETCH_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def lines_of(column: pa.Array) -> list[bytes]:
    return [b" ".join((x or b"").translate(LOWER).split()) for x in binaries(column)]


def sets_of(lines: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    hashes, counts = gram_hashes(lines, shingle, whole=True)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def superminhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """A row of register values for each set; of an empty set all are infinite."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), registers), np.inf)
    flat = out.reshape(-1)
    x = np.concatenate(sets) if len(sets) and sizes.sum() else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(registers):
        with np.errstate(over="ignore"):
            draw = mix(x + _GOLDEN * np.uint64(2 * j + 1))
            other = mix(x + _GOLDEN * np.uint64(2 * j + 2))
        k = (j + (other >> np.uint64(11)) % np.uint64(registers - j)).astype(np.int64)
        if order is None:
            place = k
        else:
            row = np.arange(len(x))
            place = order[row, k]
            order[row, k] = order[row, j]
        np.minimum.at(flat, doc * registers + place, j + (draw >> np.uint64(11)).astype(np.float64) / float(1 << 53))
        going = (out.max(axis=1) >= j + 1)[doc] if len(doc) else np.zeros(0, bool)
        if not going.any():
            break
        if order is None:
            first = k[going]
            order = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (len(first), 1))
            order[np.arange(len(first)), first] = 0
        else:
            order = order[going]
        x, doc = x[going], doc[going]
    return out


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each document and band."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), bits.shape[:2])
    for r in range(rows):
        key = mix(key ^ bits[:, :, r]) + _GOLDEN
    return key


def sketch(docs: DataFrame, *, shingle: int, rows: int, bands: int) -> DataFrame:
    """(key, n_shingles, node, bands) of rows (key, text)."""
    schema = T.StructType([docs.schema["key"], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def each(batch: pa.RecordBatch) -> dict:
        sets = sets_of(lines_of(batch.column("text")), shingle)
        keys = band_keys(superminhash(sets, rows * bands), rows, bands).view(np.int64)
        full = [len(s) > 0 for s in sets]
        return {
            "key": batch.column("key"),
            "n_shingles": [len(s) for s in sets],
            "node": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, full, strict=True)],
            "bands": [k if ok else None for k, ok in zip(keys, full, strict=True)],
        }

    return map_slices(docs, "text", schema, each, limit=SKETCH_BYTES)


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n_shingles, n, shingles) of the buckets with two nodes or more, one of those with the same members."""
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    a, b = F.xxhash64("node"), F.xxhash64("node", F.lit(7))
    sums = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b")).where("n > 1")
    kept = sums.groupBy("n", "shingles", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "shingles")
    return members.join(kept, "bucket")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the links between the sets, confirmed on all their members."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    column = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    doc, col = doc[shared], column[at[shared]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    inter = np.zeros((n, n), np.float32)
    width = max(64, (8 << 20) // (4 * n))
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [start, start + width])
        tile = np.zeros((n, min(width, int(col[-1]) + 1 - start)), np.float32)
        tile[doc[lo:hi], col[lo:hi] - start] = 1
        inter += tile @ tile.T
    inter = np.rint(inter).astype(np.int64)
    return 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) of each component's members but its root, the least index."""
    n, seen, out = len(links), np.zeros(len(links), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            near = np.flatnonzero(links[front].any(axis=0) & ~seen)
            seen[near] = True
            out += [(root, int(m)) for m in near]
            front = near
    return out


def _chunks(n: Column, shingles: Column, tile: int, tile_shingles: int) -> Column:
    """Into how many tasks so many nodes with so many shingles are cut."""
    return F.greatest(F.lit(1), F.ceil(n / tile), F.least(n, F.ceil(shingles / tile_shingles))).cast("int")


def resolved(placed: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Edges (a, b) of the spanning forests of the confirmed links among the rows (node, hashes) of each group."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def resolve(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        found = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        edges = forest(linked([found[i] for i in order], percent)) if len(nodes) > 1 else []
        names = [nodes[i] for i in order]
        return pa.table([pa.array([names[i] for i, _ in edges], pa.binary()), pa.array([names[j] for _, j in edges], pa.binary())], schema=arrow_type(schema))

    return placed.select(*by, "node", "hashes").groupBy(*by).applyInArrow(resolve, schema)


def _dealt(members: DataFrame, sets: DataFrame, percent: int, tile: int, tile_shingles: int, salt: int) -> DataFrame:
    """Edges found when each bucket's members are dealt at random into chunks, and each chunk is resolved alone."""
    chunk = F.pmod(F.xxhash64("node", "bucket", F.lit(salt)), _chunks(F.col("n"), F.col("shingles"), tile, tile_shingles)).cast("int")
    return resolved(members.select("bucket", chunk.alias("chunk"), "node").join(sets, "node"), ["bucket", "chunk"], percent)


def _across(members: DataFrame, sets: DataFrame, percent: int, tile: int, tile_shingles: int) -> DataFrame:
    """Edges between members (bucket, node, n_shingles, root) of a bucket that have different roots.

    The members of a root that fill a chunk have chunks of their own, which are not compared with one
    another; those of smaller roots share chunks. Every other pair of chunks is a task.
    """
    sizes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    own = (F.col("n") >= tile) | (F.col("shingles") >= tile_shingles)
    sizes = sizes.withColumn("of", F.when(own, F.col("root"))).groupBy("bucket", "of").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    sizes = sizes.withColumn("count", _chunks(F.col("n"), F.col("shingles"), tile, tile_shingles)).drop("n", "shingles")
    # a bucket has fewer such rows than it has chunks
    at = Window.partitionBy("bucket").orderBy("of")
    sizes = materialise(sizes.withColumn("first", F.sum("count").over(at.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["first"]).withColumn("all", F.sum("count").over(Window.partitionBy("bucket"))))
    whole = sizes.where("of IS NOT NULL").select("bucket", F.col("of").alias("root"), F.lit(True).alias("whole"), "count", "first", "all")
    shared = sizes.where("of IS NULL").select("bucket", F.col("count").alias("count_"), F.col("first").alias("first_"), F.col("all").alias("all_"))
    placed = members.join(whole, ["bucket", "root"], "left").join(shared, "bucket", "left")
    pick = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(F.col(f"{c}_")).cast("int")
    placed = placed.select("bucket", "node", F.coalesce("whole", F.lit(False)).alias("whole"), pick("count").alias("count"), pick("first").alias("first"), pick("all").alias("all"))
    mine = F.col("first") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("count")).cast("int")
    partners = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda o: ~F.col("whole") | (o < F.col("first")) | (o >= F.col("first") + F.col("count")))
    pairs = F.transform(partners, lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    placed = placed.withColumn("mine", mine).select("bucket", "node", F.explode(pairs).alias("t")).select("bucket", "node", "t.i", "t.j")
    return resolved(placed.join(sets, "node"), ["bucket", "i", "j"], percent)


def connected(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, tile: int, tile_shingles: int) -> DataFrame:
    """(node, root) of the nodes with confirmed links to others; ``sets_of`` gives (node, hashes) of some buckets' nodes."""
    roots = components(_dealt(buckets, sets_of(buckets), percent, tile, tile_shingles, 0))
    large = materialise(buckets.where(_chunks(F.col("n"), F.col("shingles"), tile, tile_shingles) > 1))
    if large.isEmpty():
        return roots
    sets = materialise(sets_of(large))
    for salt in range(1, ROUNDS + 2):
        # the members of large buckets that still have several roots, with those; what is joined is written before,
        # so that the joins find plain shuffles, of which Spark can split a hot bucket's
        named = materialise(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        several = materialise(named.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket"))
        if several.isEmpty():
            return roots
        left = named.join(several, "bucket", "left_semi")
        if salt > ROUNDS:
            found = _across(materialise(left.select("bucket", "node", "n_shingles", "root")), sets, percent, tile, tile_shingles)
        else:
            one = materialise(left.groupBy("bucket", "root").agg(F.min_by(F.struct("node", "n_shingles"), F.xxhash64("node", F.lit(salt))).alias("one")).select("bucket", "one.*"))
            totals = materialise(one.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")))
            found = _dealt(one.join(totals, "bucket"), sets, percent, tile, tile_shingles, salt)
        found = materialise(found)
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
    return roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in the edges (a, b): the least node it can reach."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).distinct())
    before = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood; that is written, so that the
        # join finds two plain shuffles, of which Spark can split the edges of a node with very many
        both = edges.union(edges.select(F.col("r").alias("v"), F.col("v").alias("r")))
        least = materialise(both.groupBy("v").agg(F.min("r").alias("m")).select("v", F.least("v", "m").alias("m")))
        edges = both.join(least, "v").where("r > v").select(F.col("r").alias("v"), F.col("m").alias("r")).distinct()
        # small star: a node and its neighbours below go to the least of those
        least = edges.groupBy("v").agg(F.min("r").alias("m"))
        below = edges.join(least, "v")
        edges = below.where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r")).union(least.select("v", F.col("m").alias("r"))).distinct()
        edges = materialise(edges)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "r"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("r").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = 85, rows: int = ROWS, bands: int = BANDS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Per row: the key, ``n_shingles``, ``component_id`` (the component's smallest key) and ``kept``."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    base = materialise(sketch(docs, shingle=shingle, rows=rows, bands=bands))
    own = base.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"))
    distinct = base.where("node IS NOT NULL").select("node", "n_shingles", "bands").dropDuplicates(["node"])
    buckets = materialise(candidate_buckets(distinct))
    roots = connected(buckets, lambda some: _sets(docs, own, some, shingle), percent, tile, tile_shingles)
    rooted = own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(tops, "root").select("node", "component_id")
    out = base.drop("bands").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))


def _sets(docs: DataFrame, own: DataFrame, buckets: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the nodes in buckets, from the text of one row each, whose key ``own`` has."""
    wanted = buckets.select("node").distinct()
    rows = materialise(own.join(wanted, "node", "left_semi").select(F.col("least").alias("key")))
    keyed = rows.where("key IS NOT NULL").distinct()
    few = keyed.count() <= BROADCAST_KEYS
    texts = docs.where("key IS NOT NULL").join(F.broadcast(keyed) if few else keyed, "key", "left_semi")
    if not rows.where("key IS NULL").isEmpty():
        texts = texts.union(docs.where("key IS NULL"))
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("hashes", T.BinaryType())])

    def each(batch: pa.RecordBatch) -> dict:
        blobs = [s.tobytes() for s in sets_of(lines_of(batch.column("text")), shingle)]
        return {"node": [hashlib.blake2b(b, digest_size=16).digest() for b in blobs], "hashes": blobs}

    return map_slices(texts, "text", schema, each).join(wanted, "node", "left_semi").dropDuplicates(["node"])


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.doc_id WHERE c.root < e.y),
r AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id
"""
