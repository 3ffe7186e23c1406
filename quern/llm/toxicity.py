"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is trained with numpy from confirmed toxic texts
(P) and unlabelled texts (U), whatever their labels, by the class-prior-corrected risk

    prior * E_P[loss(+g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

with the logistic loss; where the second term turns negative, which only overfitting can make it,
the step goes against it instead. A text's features are the distinct words (digits, a-z and bytes from
0x80, A-Z lower-cased) and their first 4 to 8 bytes; features are chosen whose frequencies in P and U
differ by more than chance. Labels, language, source and key are never inputs of a score.

Training reads a bounded sample: at most ``positives`` toxic and ``unlabelled`` other rows, the first by
a hash of the key, one text for each key; the bounds are parameters. Counting features is distributed; the driver gets at
most ``features`` of them and the sample's rows over those. Scoring reads every whole text in place,
without a shuffle.

Defined cases: null and empty texts have no features and get the bias alone; rows with a null key are
scored, and count as held out; repeated or contradicting labels: a key with any toxic label is toxic;
without toxic labels or without texts to train on every score is 0; other columns are carried along,
except that columns named like the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import binaries, map_slices, materialise, read
from quern.llm._words import words_of

POSITIVES, UNLABELLED, FEATURES = 4096, 12288, 4096
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_Z = 4.0
LEAST_COUNT = 4
#: Bytes of text whose features, some 30 times as large in memory, are listed at once.
LISTED_BYTES = 1 << 19


def features_of(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its beginnings."""
    return [word + b"$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text is divisible by ``folds``; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


@dataclass
class Model:
    """Weights of features; a text's score is the logistic function of the bias and the weights of what it has."""

    weights: dict[bytes, float]
    bias: float

    def score(self, raw: bytes | None, known: dict[bytes, tuple[bytes, ...]] | None = None) -> float:
        """``known``: words with their features in the model, kept from text to text of a slice."""
        known = {} if known is None else known
        found: set[bytes] = set()
        for word in set(words_of(raw)):
            if (own := known.get(word)) is None:
                own = known[word] = tuple(f for f in features_of(word) if f in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(sorted(self.weights[f] for f in found))
        return 0.0 if z == -np.inf else float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, n_features: int, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk. ``rows``, ``columns``: where the sparse 0/1 matrix is 1."""
    n, p, u = len(positive), max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns], minlength=n) + b
        as_negative = np.logaddexp(0, z)
        rest = as_negative[~positive].mean() - prior * as_negative[positive].mean() if u else 0.0
        slope = np.where(positive, -prior * sigma(z) / p, sigma(z) / u)
        dz = np.where(positive, -prior * sigma(-z) / p, 0.0) + slope if rest >= 0 else -slope
        grad = np.append(np.bincount(columns, weights=dz[rows], minlength=n_features) + decay * w, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _features(rows: DataFrame) -> DataFrame:
    """(positive, features) of rows (positive, text)."""
    schema = T.StructType([T.StructField("positive", T.BooleanType()), T.StructField("features", T.ArrayType(T.BinaryType()))])

    def each(batch: pa.RecordBatch) -> dict:
        return {"positive": batch.column("positive"), "features": [list({f for w in set(words_of(x)) for f in features_of(w)}) for x in binaries(batch.column("text"))]}

    return map_slices(rows, "text", schema, each, limit=LISTED_BYTES)


def greatest_prior(shares: list[tuple[float, float]], n_p: int, n_u: int) -> float:
    """The greatest share of toxic texts in U that features' shares in P and U allow: a feature is at least as
    frequent in U as U's toxic texts make it. Sampling errors of four deviations are granted."""
    error = lambda share, n: LEAST_Z * np.sqrt(max(share * (1 - share), 1 / n) / n)
    return min([(u + error(u, n_u)) / (p - error(p, n_p)) for p, u in shares if p > 2 * error(p, n_p)], default=1.0)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """A model from the training folds; ``prior`` is by default the share of toxic rows among their labelled ones,
    or what the features allow, if that is less."""
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(~held_out(F.col("key")))
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(~held_out(F.col("key")) & F.col("label").isNotNull()).groupBy("key").agg(F.max("label").alias("label"))
    share = prior if prior is not None else known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0] or 0.0
    first = lambda df, n: df.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(n)
    # both samples have a fixed bound, so they are broadcast
    # labels may name absent documents, which must not take places
    toxic = first(known.where("label > 0").join(own.select("key"), "key", "left_semi"), positives)
    one = lambda keys: own.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    p = one(toxic).select(F.lit(True).alias("positive"), "text")
    u = one(first(own, unlabelled)).select(F.lit(False).alias("positive"), "text")
    sample = materialise(_features(p.unionByName(u)))
    sizes = {r[0]: r[1] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, -np.inf)
    counts = sample.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    both = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    chosen = counts.where(F.col("p") + F.col("u") >= LEAST_COUNT).select("f", "p", "u", z.alias("z")).where(F.abs("z") >= LEAST_Z)
    rows = chosen.orderBy(F.abs("z").desc(), "f").limit(features).collect()
    if prior is None:
        share = min(share, greatest_prior([(r["p"] / n_p, r["u"] / n_u) for r in rows], n_p, n_u))
    names = [bytes(r["f"]) for r in rows]
    at = {f: i for i, f in enumerate(names)}
    schema = T.StructType([T.StructField("positive", T.BooleanType()), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([[at[f] for f in fs if f in at] for fs in batch.column("features").to_pylist()], pa.list_(pa.int32()))], names=["positive", "at"])

    table = sample.mapInArrow(placed, schema).toArrow()
    lists = table.column("at").combine_chunks()
    columns, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    order = np.repeat(np.arange(len(sizes)), sizes)
    w, b = fit(order, columns, table.column("positive").to_numpy(), len(names), min(max(share, 1e-4), 1 - 1e-4))
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, b)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    docs = docs.select([c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict:
        known: dict[bytes, tuple[bytes, ...]] = {}
        found = [shared.value.score(x, known) for x in binaries(batch.column(text))]
        return {c: batch.column(c) for c in docs_columns} | {"score": found, "predicted": [int(x >= 0.5) for x in found]}

    docs_columns = list(docs.columns)
    return map_slices(docs, text, schema, each)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
