"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

A text is normalised by lower-casing A-Z and taking words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
(on UTF-8 bytes: digits, a-z and every byte from 0x80). A window is ``window`` consecutive words of
an item; an item of fewer words, but at least one, is one window. A document word that lies inside
any occurrence of a window is hit.

Texts stream through the automaton once, in their own partitions: no shuffle, no join. The
benchmark is read in blocks of at most ``block_bytes`` of window text, and only one block is
broadcast at a time, so what is broadcast has a fixed bound; a benchmark of several blocks costs one
pass of the documents each, and the passes' hits are joined by a checkpoint in between.

Defined cases: null and empty texts have no words and are clean; null items have no windows; items
with equal windows all count; repeated rows of either table are handled as rows; an empty benchmark
leaves every document clean; texts of any length are scanned whole; a null item_id counts as an item, last in
order; other columns are carried along, except that columns named like the
outputs are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import binaries, map_slices, materialise, read

WINDOW = 10
#: Window text of a block; its automaton takes some 25 times as much in each Python worker.
BLOCK_BYTES = 4 << 20
#: On UTF-8: A-Z to a-z, word bytes as they are, all else to a space. Lengths, and so offsets, stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_automata: dict[str, object] = {}


def windows_of(text: bytes | None, window: int) -> set[bytes]:
    """The item's distinct windows, each as its words with a space on both sides."""
    words = (text or b"").translate(FOLD).split()
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[dict[bytes, list[str | None]]]:
    """Windows with the items they come from, in blocks of bounded size; items arrive one partition at a time."""
    block: dict[bytes, list[str | None]] = {}
    held = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        for w in windows_of(None if row[1] is None else row[1].encode(), window):
            block.setdefault(w, []).append(row[0])
            held += len(w) + 40
            if held >= block_bytes:
                yield block
                block, held = {}, 0
    if block:
        yield block


def _automaton(name: str, shared):
    """The block's automaton, built once for each Python worker; only the latest is kept."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for w, items in pickle.loads(shared.value).items():
            found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(items)))
        if len(found):
            found.make_automaton()
        _automata[name] = found
    return _automata[name]


def scan_text(automaton, raw: bytes) -> tuple[int, list[tuple[int, int]], set]:
    """(words, hit word ranges [from, to), items with occurring windows), in one scan of the text."""
    words = raw.translate(FOLD).split()
    if not words or not len(automaton):
        return len(words), [], set()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spans: list[tuple[int, int]] = []
    items: set = set()
    word = place = 0  # spaces counted before `place`
    for end, (length, owners) in automaton.iter(line):
        word += line.count(" ", place, end)
        place = end
        items.update(owners)
        spans.append((word - length, word))
    return len(words), merged(spans), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (merged hit ranges: words ``from_word`` to ``to_word``, and the
    bytes ``from_byte`` to ``to_byte`` of the original UTF-8 text) and ``item_ids`` (of any type, as strings; sorted, distinct)."""
    own = ["n_words", "hits", "item_ids"]
    docs = docs.select([c for c in docs.columns if c not in own])
    spark = docs.sparkSession
    hit = T.StructType([T.StructField(n, T.LongType()) for n in ("from_word", "to_word", "from_byte", "to_byte")])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit)), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    first = True
    for block in blocks_of(benchmark, item, item_text, window, block_bytes):
        if not first:
            docs = materialise(docs)
        docs = _scan(docs, spark.sparkContext.broadcast(pickle.dumps(block)), text, schema, first)
        first = False
    return _scan(docs, spark.sparkContext.broadcast(pickle.dumps({})), text, schema, True) if first else docs


def _scan(docs: DataFrame, shared, text: str, schema: T.StructType, first: bool) -> DataFrame:
    carried = [f.name for f in schema.fields[:-3]]
    name = uuid.uuid4().hex

    def each(batch: pa.RecordBatch) -> dict:
        automaton = _automaton(name, shared)
        earlier = [(set(), [])] * batch.num_rows if first else [(set(i), [(h["from_word"], h["to_word"]) for h in hs]) for i, hs in zip(batch.column("item_ids").to_pylist(), batch.column("hits").to_pylist(), strict=True)]
        counts, hits, owners = [], [], []
        for raw, (had, spans) in zip(binaries(batch.column(text)), earlier, strict=True):
            n, found, items = scan_text(automaton, raw or b"")
            counts.append(n)
            owners.append(sorted(had | items, key=lambda x: (x is None, x)))
            hits.append(_placed(raw, merged([*spans, *found])) if found or spans else [])
        return {c: batch.column(c) for c in carried} | {"n_words": counts, "hits": hits, "item_ids": owners}

    return map_slices(docs, text, schema, each)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges without overlap or contact, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _placed(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with the bytes they take in the original text."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    return [{"from_word": a, "to_word": b, "from_byte": at[a][0], "to_byte": at[b - 1][1]} for a, b in spans]


def ids_sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    names = F.filter("item_ids", lambda x: x.isNotNull())
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["to_word"] - h["from_word"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bp AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS win, least(len(w), 10) AS n FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT row, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dp),
m AS (SELECT DISTINCT row, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM m) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT row, item_id FROM m) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.row = h.row LEFT JOIN i ON d.row = i.row
"""
