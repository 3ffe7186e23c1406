"""Best-fit packing of tokenised documents into sequences of fixed length.

A document becomes its token ids, by the public tokenizer file given as ``tokenizer``, and then id 0.
Only a document longer than ``length`` is cut, into pieces of ``length``; its last piece may be
shorter. Pieces are packed by bounded-space online best-fit: a fixed number of open bins
(``open_bins``), found through a bitset keyed by free space; a piece goes to the bin that it fills
best, and when a new bin is needed beyond the bound, the fullest open bin closes.

Plan: tokenise in place (no shuffle; the piece table is small beside the text and is checkpointed, so
tokenising happens once) - deal rows to packers at random, equal ones like any others, about
``pieces_per_packer`` each, so a packer's memory is bounded and a bin's worth of loss at its end is spread over many full bins - pack -
then pack once more what the packers' last open bins hold, until one packer takes all of it.

Defined cases: null and empty texts are the single id 0; repeated rows are packed as rows; an empty
table gives no rows; of bins with equal room the latest opened or filled is taken; a text of any length is encoded
whole, in one task, and gives pieces of bounded size; columns other than the two named are not read, so their names
cannot clash.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import arrow_type, binaries, crc32_le, map_slices, materialise, read
from quern.llm._words import LOWER

LENGTH = 2048
END = 0
OPEN_BINS = 512
PIECES_PER_PACKER = 1 << 16
#: Distinct words whose ids a Python worker keeps (some 150 bytes each); beyond, those go that came up once.
CACHED_WORDS = 1 << 18
#: Characters of text whose words are looked up together.
WORDS_BYTES = 1 << 19


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins words across white space.

    Words repeat, so each distinct one is encoded once; when too many are held, those that only one text had go. A word of lower-case Latin-1 letters, with or
    without ASCII punctuation behind them, is one or two pre-tokens that the normaliser leaves as they
    are, so the tokenizer's model takes them directly; any other word goes through the whole tokenizer.
    Texts that hold a special token, or characters on which ``str.split`` and the tokenizer differ, are
    encoded whole. A-Z are lower-cased first, as the normaliser does so itself, but not in texts where one
    may be followed by a combining mark: the normaliser composes the two before.
    """

    ODD = frozenset(map(chr, (*range(0x1C, 0x20), 0x180E, 0x200B, 0xFEFF)))
    MARKED = re.compile("[a-z][\u0300-\U0010ffff]")
    PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.model = self.tokenizer.model
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spare = iter(range(256, 512))
        kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.as_bytes = {b: chr(b if b in kept else next(spare)) for b in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])
        self.uses = np.zeros(0, np.uint8)

    def _thin(self) -> None:
        """Keeps the words that several texts had since the last time, if they leave room; forgets the others."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.cached // 2:
            keep = keep[:0]
        words, ends, flat = list(self.known), np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32)
        kept = [flat[ends[k] : ends[k + 1]] for k in keep.tolist()]
        names = [words[k] for k in keep.tolist()]
        del ends, flat
        self._forget()
        self._add(names, np.concatenate(kept) if kept else [], [len(x) for x in kept])

    def _add(self, words: list[str], ids, counts: list[int]) -> None:
        """Words that are not known, with their ids one after another and how many each has."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat.frombytes(np.asarray(ids, np.uint32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.asarray(counts, np.int64))).tobytes())
        if len(self.uses) < len(self.known):
            self.uses = np.concatenate([self.uses, np.zeros(max(len(self.known) - len(self.uses), len(self.uses) // 2), np.uint8)])

    def _ids(self, word: str) -> list[int]:
        k = self.known[word]
        return self.flat[self.ends[k] : self.ends[k + 1]].tolist()

    def _learn(self, words: list[str]) -> None:
        """Words that are not known; pre-tokens first, then those made of two, then the rest."""
        parts, double, rest = [], [], []
        for word in words:
            if word.isascii() and word.isalpha() and word.islower():
                parts.append(word)
            elif m := self.PLAIN.fullmatch(word):
                if m[2]:
                    double.append((word, m[1], m[2]))
                else:
                    parts.append(word)
            else:
                rest.append(word)
        found = dict.fromkeys(parts)
        for _, *both in double:
            found.update((x, None) for x in both if x not in self.known)
        tokenize, ids, counts = self.model.tokenize, [], []
        for part in found:
            tokens = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.as_bytes))
            ids += [t.id for t in tokens]
            counts.append(len(tokens))
        self._add(list(found), ids, counts)
        # a word like "..." may be a part of another as well, and is there then
        lists = [self._ids(x) + self._ids(y) for _, x, y in double]
        lists += [e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)] if rest else []
        names = [w for w, _, _ in double] + rest
        fresh = [(w, x) for w, x in zip(names, lists, strict=True) if w not in self.known]
        self._add([w for w, _ in fresh], [i for _, x in fresh for i in x], [len(x) for _, x in fresh])

    def encode(self, raws: list[bytes | None]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        # millions of small lists and no cycles: the collector would only walk them again and again
        was_on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(raws)
        finally:
            if was_on:
                gc.enable()

    def _encode(self, raws: list[bytes | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = []
        held: list[list[str]] = []
        size = 0

        def settle() -> None:
            found = iter(self._by_word(held))
            for i in range(settled, len(out)):
                if out[i] is None:
                    out[i] = next(found)

        settled = 0
        for raw in raws:
            text = (raw or b"").translate(LOWER).decode("utf-8", "replace")
            if not text.isascii() and self.MARKED.search(text):
                text = raw.decode("utf-8", "replace")
            if any(c in text for c in self.special) or not self.ODD.isdisjoint(text):
                out.append(self.whole((raw or b"").decode("utf-8", "replace")))
            else:
                out.append(None)
                held.append(text.split())
                size += len(text)
            if size >= WORDS_BYTES:
                settle()
                held, size, settled = [], 0, len(out)
        settle()
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _by_word(self, texts: list[list[str]]) -> list[np.ndarray]:
        words = list(chain.from_iterable(texts))
        at = list(map(self.known.get, words))
        if missing := [i for i, k in enumerate(at) if k is None]:
            new = list(dict.fromkeys([words[i] for i in missing]))
            if len(self.known) + 2 * len(new) > self.cached:
                self._thin()
                at, missing = [None] * len(words), range(len(words))
                new = [w for w in dict.fromkeys(words) if w not in self.known]
            self._learn(new)
            known = self.known
            for i in missing:
                at[i] = known[words[i]]
        at, held = np.array(at, np.int64), np.frombuffer(self.ends, np.int64)
        # in how many lots of texts a word was, up to 255 and round again
        self.uses[at] += np.uint8(1)
        starts, lengths = held[at], held[at + 1] - held[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        ids = np.frombuffer(self.flat, np.uint32)[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)] if ends[-1] else np.empty(0, np.uint32)
        return np.split(ids, ends[np.cumsum([len(x) for x in texts])[:-1]]) if texts else []


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_of(path: str, cached: int = CACHED_WORDS) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, cached) not in _tokenizers:
        _tokenizers[path, cached] = WordTokenizer(path, cached)
    return _tokenizers[path, cached]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, keep_ids: bool = True, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: ``key``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col(key), F.col(text).cast("string").alias("text" if key != "text" else "text_"))
    text = docs.columns[1]
    fields = [docs.schema[key], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else [])])

    def each(batch: pa.RecordBatch) -> dict:
        found = tokenizer_of(path, cached_words).encode(binaries(batch.column(text)))
        out: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "ids")}
        for i, ids in enumerate(found):
            ids = np.append(ids, np.uint32(END))
            for k, start in enumerate(range(0, len(ids), length)):
                own = ids[start : start + length]
                for n, v in (("row", i), ("piece", k), ("start", start), ("length", len(own)), ("ids_crc32", crc32_le(own))):
                    out[n].append(v)
                if keep_ids:
                    out["ids"].append(own.astype(np.int64))
        return out | {key: batch.column(key).take(pa.array(out.pop("row"), pa.int32()))}

    return map_slices(docs, text, schema, each)


class BestFit:
    """Bounded-space online best-fit. ``put`` says which bin a piece goes to and where in it.

    ``bins[free]`` holds the open bins with so much room; bit ``free`` of ``bits`` is set where there
    are any. The best fit is the lowest set bit at or above the piece's size, found by shifting.
    """

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.bits, self.bins, self.open, self.made = 0, [[] for _ in range(length + 1)], 0, 0
        self.closed: list[int] = []

    def put(self, size: int) -> tuple[int, int]:
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            own = self._take(free)
        else:
            if self.open == self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, own = self.length, self.made
            self.made += 1
        if free > size:
            self.bins[free - size].append(own)
            self.bits |= 1 << (free - size)
            self.open += 1
        else:
            self.closed.append(own)
        return own, self.length - free

    def _take(self, free: int) -> int:
        own = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return own


def _packed(pieces: DataFrame, packers: int, length: int, open_bins: int, level: int) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and ``open`` (whether the bin was still open at its packer's end).

    The pieces are checkpointed, so a row's number is its own whenever it is read again, and wholly equal rows are
    dealt to different packers."""
    dealt = pieces.withColumn("_order", F.xxhash64(F.lit(level), F.monotonically_increasing_id()))
    dealt = dealt.repartition(packers, "_order").sortWithinPartitions("_order").drop("_order")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        held, fit = [], BestFit(length, open_bins)
        for batch in batches:
            held.append((batch, [fit.put(n) for n in batch.column("length").to_pylist()]))
        closed = set(fit.closed)
        types = arrow_type(schema)
        for batch, places in held:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base | b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64()), pa.array([b not in closed for b, _ in places], pa.bool_())], schema=types)

    return dealt.mapInArrow(run, schema)


def pack(pieces: DataFrame, *, length: int = LENGTH, open_bins: int = OPEN_BINS, pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Pieces (as ``pieces_of`` gives them) with ``sequence_id`` and ``offset``.

    Every bin that its packer closed is final. The bins left open at the packers' ends, a bounded
    number for each, are emptied and their pieces dealt to fewer packers, until one had them all; where
    packers take so few pieces that hardly a bin closes, the next ones take twice as many.
    """
    pieces = materialise(pieces)
    done, level, n = None, 0, pieces.count()
    while True:
        packers = max(1, -(-n // pieces_per_packer))
        packed = _packed(pieces, packers, length, open_bins, level)
        if packers == 1:
            final = packed.drop("open")
            return done.unionByName(final) if done is not None else final
        packed = materialise(packed)
        closed = packed.where(~F.col("open")).drop("open")
        done = closed if done is None else done.unionByName(closed)
        pieces = packed.where("open").drop("sequence_id", "offset", "open")
        left = pieces.count()
        if left > n // 2:
            pieces_per_packer *= 2
        n, level = left, level + 1


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(pieces_of(read(spark, sf_dir, "documents"), keep_ids=False, cached_words=1 << 20))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
