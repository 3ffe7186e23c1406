"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that
hold benchmark passages go, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Null and empty texts are kept by the filters (they are neither toxic, nor copies of one
another, nor contaminated) and packed as the end token alone; rows that repeat one another wholly are
near-duplicates, so one of them stays; an empty table passes as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, dedup, pack, toxicity
from quern.llm._common import materialise, read, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: percent of shared five-word shingles.
PERCENT = 80
#: Rows to be removed that are broadcast (about 40 bytes each); above, the tables are joined by a shuffle.
BROADCAST_ROWS = 1 << 19


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input and the table ``labels``, doesn't reject."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; of rows with that doc_id the first."""
    docs = _numbered(docs)
    found = dedup.near_duplicates(docs, key="_row", percent=PERCENT)
    gone = found.where("NOT kept").select(F.col("_row").alias("gone")).persist()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col("_row") == F.col("gone"), "left_anti").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``: doc_id and a place that stays the row's own however often, and by how many executors,
    it is read. In files that is the file and the row's index in it; other rows are numbered and written."""
    try:
        place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
        return docs.select(*COLUMNS, F.struct("doc_id", *place).alias("_row"))
    except AnalysisException:
        return materialise(docs.select(*COLUMNS, F.struct("doc_id", F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_row")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack.pack(pack.pieces_of(docs, keep_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL can express training, SuperMinHash or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
