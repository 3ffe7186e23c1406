"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification.

Writing. Each row becomes one uncompressed WARC/1.1 record whose block is an HTTP response with the
html in UTF-8 as payload, in archives of at most ``archive_bytes`` of payload or one record. Of rows with equal payloads of at least ``min_bytes``, the one with the
largest key is a response and the others are revisits that refer to it and carry the HTTP header
only. All of it is column expressions and Spark's text writer with CR LF as line separator, so the
payloads are not shuffled: digests find the repeated payloads by map-side aggregation.

Reading. Payloads may hold anything, also what looks like a record. A task emits, for every place
where a file has the magic and a well-formed header, that offset and its successor's, one header and
one content length further. From the file's start, pointer jumping (each round doubles the stretch
of the chain that a record reaches over) keeps only the records that the chain reaches. A chain that
does not end at the file's end is an error, as is a payload that contradicts its digest.

Defined cases: a null html is an empty payload; a null key is written as such and counts as smaller
than any; rows that repeat the largest key of a group are all responses; an empty table gives
archives without records; a header has any length; a payload or address of up to 2 GiB, Spark's bound for a
cell, is kept whole; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import arrow_type, read, shared_dir

MIN_BYTES = 1000
#: Bytes of payload that an archive has at most, unless it is one record; archives are read a file to a task.
ARCHIVE_BYTES = 64 << 20
#: Records of payloads up to so many bytes share archives; an archive has the fewer, the larger its class.
CLASSES = (1 << 15, 1 << 19, 1 << 23)
#: Repeated payloads whose table (about 80 bytes each) is broadcast; above, the tables are joined by a shuffle.
BROADCAST_GROUPS = 1 << 17
MAGIC = re.compile(rb"WARC/1\.\d+\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:quern:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, *, key: str, html: str, url: str | None, min_bytes: int) -> DataFrame:
    """``value``, a record but for its last CR LF, and ``bytes``, the size of its row's payload or address."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), body.alias("body"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"))
    rows = rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL").select(F.col("digest").alias("of"), "top")
    groups = groups.persist()
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, (F.col("digest") == F.col("of")) & (F.col("bytes") >= min_bytes), "left")
    again = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    target = F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20"))).otherwise(F.lit(""))
    refers = F.when(again, F.concat(line("WARC-Refers-To", _urn(F.col("top"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        target,
        refers,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block, F.lit("\r\n")).alias("value"), F.greatest("bytes", F.coalesce(F.octet_length("url"), F.lit(0)).cast("long")).alias("bytes"))


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", html: str = "html", url: str | None = "url", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes archives into the folder ``path``: a pass over the rows for each class of sizes that has any."""
    size = F.greatest(F.coalesce(F.octet_length(F.col(html).cast("string")), F.lit(0)), F.coalesce(F.octet_length(F.col(url).cast("string")), F.lit(0)) if url else F.lit(0))
    bounds = [0, *CLASSES, 1 << 31]
    seen = pages.select(size.alias("n")).agg(*[F.count_if((F.col("n") > low) & (F.col("n") <= high)).alias(str(high)) for low, high in zip(bounds, bounds[1:], strict=False)]).first()
    # empty payloads are of the first class, which is written in any case
    all_records = records(pages, key=key, html=html, url=url, min_bytes=min_bytes)
    for low, high in zip(bounds, bounds[1:], strict=False):
        if low and not seen[str(high)]:
            continue
        own = all_records.where((F.col("bytes") <= high) & (F.col("bytes") > (low or -1))).select("value")
        most = max(1, archive_bytes // high)
        own.write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(path)
    return path


def candidates(data: bytes) -> list[tuple]:
    """(offset, successor, key, type, refers_to, digest, payload bytes, whether the payload agrees) of what looks like a record."""
    # headers may have any length; those that end at the same place share their lines, which are read once
    out, stop, named, seen = [], -1, {}, {}
    for m in MAGIC.finditer(data):
        if stop < m.end() - 2:
            if (stop := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
                break
            named, start, seen = {}, m.end(), {}
            for x in data[start:stop].split(b"\r\n"):
                k, _, v = x.partition(b":")
                named[k.strip().lower()] = start, v.strip()
                start += len(x) + 2
        own = tuple(named[k][1] if k in named and named[k][0] >= m.end() else b"" for k in _NAMES)
        if own not in seen:
            seen[own] = _record(data, stop + 4, dict(zip(_NAMES, own, strict=True)))
        if seen[own]:
            out.append((m.start(), *seen[own]))
    return out


_NAMES = (b"content-length", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest", b"warc-type")


def _record(data: bytes, body: int, named: dict[bytes, bytes]) -> tuple | None:
    size = named[b"content-length"]
    if not size.isdigit():
        return None
    end = body + int(size)
    number = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:quern:(-?\d+)>", named.get(x, b""))) else None
    digest = named.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace").lower()
    kind, payload, agrees = named.get(b"warc-type", b"").decode("ascii", "replace"), None, True
    http = data.find(b"\r\n\r\n", body, end)
    if http >= 0:
        if m := re.search(rb"\r\ncontent-length:\s*(\d+)", data[body : http + 2], re.I):
            payload = int(m[1])
        if kind == "response":
            agrees = payload in (None, end - http - 4) and digest in ("", hashlib.sha1(memoryview(data)[http + 4 : end]).hexdigest())
            payload = end - http - 4
    return end + 4, number(b"warc-record-id"), kind, number(b"warc-refers-to"), digest, payload, agrees


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets the chain from offset 0 reaches, by pointer jumping."""
    n = len(offsets)
    reach = np.zeros(n + 1, bool)
    reach[0] = n > 0 and offsets[0] == 0
    at = np.searchsorted(offsets, successors)
    jump = np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n), n) if n else np.zeros(1, np.int64)
    for _ in range(max(1, n).bit_length()):
        reach[jump[np.flatnonzero(reach)]] = True
        jump = jump[jump]
    return reach[:n]


_FIELDS = [("offset", T.LongType()), ("successor", T.LongType()), ("id", T.LongType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("agrees", T.BooleanType())]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, id, record_type, refers_to, payload_digest, payload_bytes) of the records in the folder's archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")
    found = T.StructType([T.StructField("file", T.StringType()), T.StructField("size", T.LongType()), *(T.StructField(n, t) for n, t in _FIELDS)])

    def emit(batches):
        types = arrow_type(found)
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                data = content.as_py()
                # a file without any candidate but with bytes must not pass for an empty one
                rows = candidates(data) or ([(-1, -1, None, "", None, "", None, True)] if data else [])
                columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in _FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), pa.array([len(data)] * len(rows), pa.int64()), *(pa.array(c, types.field(f).type) for c, (f, _) in zip(columns, _FIELDS, strict=True))], schema=types)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        offsets, successors = table.column("offset").to_numpy(), table.column("successor").to_numpy()
        keep = reachable(offsets, successors)
        name, size = table.column("file")[0].as_py(), table.column("size")[0].as_py()
        if not keep.any() or successors[keep][-1] != size:
            raise ValueError(f"{name}: the chain of records breaks at byte {successors[keep][-1] if keep.any() else 0} of {size}")
        table = table.filter(pa.array(keep))
        if not all(table.column("agrees").to_pylist()):
            raise ValueError(f"{name}: a payload contradicts its record's digest or length")
        return table

    return files.mapInArrow(emit, found).groupBy("file").applyInArrow(chain, found).drop("size", "successor", "agrees")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM t
"""
