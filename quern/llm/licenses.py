"""License scans by diagonal voting.

All rolling hashes of a text's words are joined with the positions of the same hashes in license
templates. A match at text word ``i`` and template word ``j`` votes for the diagonal ``i - j``, which fixes
one place in the text; votes are aggregated by row, template and diagonal into the set of template words
that they hit, and neighbouring diagonals (words inserted or deleted) are merged into one region. A template's grams have
up to ``gram`` words, fewer if it is so short that the errors allowed could leave none whole; so a region
with fewer votes than those errors leave cannot hold the template. Others are verified: the template is
aligned with the region's words at the least number of words inserted, lost or changed, and covers
``1 - errors / words``. It is a span from ``min_cover`` on, if none of the words that name licenses
(``NAMING``) is inserted, lost or changed. Of overlapping spans the best covered, then longest, stays;
it gives the template's label and, as score, the coverage.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Besides the templates,
base phrases are found exactly: every place where a phrase's words stand one after another. A base
phrase counts as covered in full.

Plan: one pass in Python over texts in place finds words, base places and rolling hashes (numpy); a text
goes on in parts of at most ``PART`` words, so no row grows with its text. The hashes are exploded in the
JVM and meet the templates' by a broadcast join, whose size is fixed by the templates (at most 64 words
each). A vote carries the few words around its diagonal, which is all that verifying needs. Shuffled are
votes and a short record for each row, combined before the shuffle; rows equal in key and text are one
record with a count. Votes of one text meet in one row, some hundred bytes for each diagonal hit.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows count as
rows; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import arrow_type, binaries, map_slices, read
from quern.llm._words import gram_hashes, words_of

GRAM = 4
#: Words of a text that go on in one row.
PART = 65536
#: Neighbouring diagonals at most so far apart are merged: words inserted or deleted in between.
DRIFT = 3
MIN_COVER = 0.8
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, text) of short public notices; a label may have several wordings.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *((f"cc-{short.lower()}", text) for short, long in (("BY-NC", "NonCommercial"), ("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives")) for text in (f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License.")),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Words that name licenses: a span has the same of them as its template.
NAMING = frozenset(b"mit apache gnu general public lesser affero mozilla attribution sharealike noncommercial noderivatives noderivs derivs derivatives commercial share alike sa nc nd".split())


class Templates:
    """Templates with their rolling grams, in order of hashes."""

    def __init__(self, templates: list[tuple[str, str]], gram: int, drift: int, min_cover: float):
        self.labels, self.words = [x for x, _ in templates], [words_of(t.encode()) for _, t in templates]
        if bad := [t for (_, t), w in zip(templates, self.words, strict=True) if not 1 <= len(w) <= 64]:
            raise ValueError(f"a template must have 1 to 64 words: {bad[0][:60]}")
        self.errors = [int((1 - min_cover) * len(w) + 1e-9) for w in self.words]
        # an error destroys at most as many grams as a gram has words
        left = lambda k, n: len(self.words[k]) - n + 1 - n * self.errors[k]
        self.gram = [max([n for n in range(1, gram + 1) if left(k, n) > 0], default=1) for k in range(len(templates))]
        self.least = [max(1, left(k, n)) for k, n in enumerate(self.gram)]
        self.gap = [max(drift, e) for e in self.errors]
        self.naming = [NAMING.intersection(w) for w in self.words]
        self.sizes = sorted(set(self.gram))
        # words that a vote needs on either side of its place; also those up to the next diagonal of its region
        self.margin = max((len(w) + e + g for w, e, g in zip(self.words, self.errors, self.gap, strict=True)), default=0)

    def grams(self) -> list[tuple[int, int, int, int, int, int]]:
        """(hash, template, place, words of the gram, words wanted before it, words wanted from it on)."""
        out = []
        for k, (w, n, e, g) in enumerate(zip(self.words, self.gram, self.errors, self.gap, strict=True)):
            for j, h in enumerate(gram_hashes([b" ".join(w)], n)[0].view(np.int64).tolist()):
                out.append((h, k, j, n, j + e, len(w) - j + e + g))
        return out

    def spans(self, votes: list[tuple[int, int, int, int, bytes]]) -> list[tuple[str, int, int, float]]:
        """Verified (label, first word, word after, coverage), none overlapping another. A vote is (template,
        diagonal, bits of matched template words, place of the first of the words around it, these words)."""
        regions: list[list] = []
        for k, d, bits, start, window in sorted(votes):
            if regions and regions[-1][0] == k and d - regions[-1][2] <= self.gap[k]:
                region = regions[-1]
                region[2], region[3] = d, region[3] | bits
                region[5] += window.split()[region[4] + len(region[5]) - start :]
            else:
                regions.append([k, d, d, bits, start, window.split()])
        found = set()
        for k, low, high, bits, first, words in regions:
            if bits.bit_count() >= self.least[k]:
                size, e = len(self.words[k]), self.errors[k]
                at = max(0, low) - first
                if low == high and words[at : at + size] == self.words[k]:
                    found.add((0.0, -size, low, low + size, k))
                    continue
                for start, stop, cost in align(self.words[k], words[: high + size + e - first]):
                    if cost <= e and NAMING.intersection(words[start:stop]) == self.naming[k]:
                        found.add((cost / size, -size, first + start, first + stop, k))
        out, taken = [], set()
        for loss, _, start, stop, k in sorted(found):
            if taken.isdisjoint(range(start, stop)):
                taken.update(range(start, stop))
                out.append((self.labels[k], start, stop, 1 - loss))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def parts_of(line: bytes, gram: int, margin: int, size: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Of each part of a text: the place of its first word, how many words before it are kept, the words whose
    grams count, and these with ``margin`` words on either side."""
    if line.count(b" ") < size:
        yield 0, 0, line, line
        return
    words = line.split(b" ")
    for start in range(0, len(words), size):
        before, stop = min(start, margin), start + size + gram - 1
        yield start - before, before, b" ".join(words[start:stop]), b" ".join(words[start - before : stop + margin])


def word_starts(lines: list[bytes]) -> pa.Array:
    """Where each word of each line starts, and one past the line's end."""
    out = [np.concatenate([[0], np.flatnonzero(np.frombuffer(x, np.uint8) == 32) + 1, [len(x) + 1]]) for x in lines]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).astype(np.int32)))


def listed_hashes(lines: list[bytes], sizes: list[int], heads: np.ndarray) -> pa.Array:
    """The hashes of each line's grams, size by size; where ``heads``, after one null."""
    found = [gram_hashes(x, n) for x, n in ((lines, n) for n in sizes)]
    total = heads + sum(c for _, c in found)
    at = np.cumsum(total) - total + heads
    ends = np.concatenate([[0], np.cumsum(total)]).astype(np.int32)
    values, empty = np.zeros(int(total.sum()), np.int64), np.zeros(int(total.sum()), bool)
    empty[ends[:-1][heads > 0]] = True
    for hashes, counts in found:
        values[np.arange(len(hashes)) + np.repeat(at - (np.cumsum(counts) - counts), counts)] = hashes.view(np.int64)
        at = at + counts
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, mask=empty))


def align(template: list[bytes], words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, stop, words inserted, lost or changed) of the best place of the template that ends at each stop; of
    equal ones the latest start."""
    size, out = len(template), []
    # (cost, -start) of the first j words of the template that end here
    column = [(j, 0) for j in range(size + 1)]
    for i, word in enumerate(words):
        before, column = column, [(0, -i - 1)]
        for j in range(size):
            cost, start = before[j]
            best = (cost + (template[j] != word), start)
            for cost, start in (before[j + 1], column[j]):
                if cost < best[0]:
                    best = min(best, (cost + 1, start))
            column.append(best)
        cost, start = column[-1]
        out.append((-start, i + 1, cost))
    return out


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = BASE, templates: list[tuple[str, str]] = TEMPLATES, gram: int = GRAM, drift: int = DRIFT, min_cover: float = MIN_COVER, part_words: int = PART) -> DataFrame:
    """Per row: the key, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and
    ``spans`` (label, from_word, to_word, cover)."""
    spark, known = docs.sparkSession, Templates(templates, gram, drift, min_cover)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    longs = ("n_words", "n_base", "first_word", "last_word")
    own = [docs.schema["key"], *(T.StructField(n, T.LongType()) for n in longs), T.StructField("base_labels", T.StringType()), T.StructField("digest", T.BinaryType())]
    part = {"base": T.LongType(), "before": T.LongType(), "counted": T.LongType(), "line": T.BinaryType(), "starts": T.ArrayType(T.IntegerType()), "hashes": T.ArrayType(T.LongType())}
    needles = {b" " + p.encode() + b" ": label for p, label in phrases.items()}
    sizes, widest, margin = known.sizes, max(known.sizes, default=1), known.margin

    def each(batch: pa.RecordBatch) -> dict:
        lines = [b" ".join(words_of(x)) for x in binaries(batch.column("text"))]
        of, parts, record = [], [], []
        for r, line in enumerate(lines):
            padded, found = b" " + line + b" ", []
            for needle, label in needles.items():
                if needle in padded:
                    found += [(padded.count(b" ", 0, m.start()), label) for m in re.finditer(b"(?=" + re.escape(needle) + b")", padded)]
            at = [x for x, _ in found]
            record.append((line.count(b" ") + 1 if line else 0, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})), md5(line).digest()))
            own_parts = list(parts_of(line, widest, margin, part_words))
            parts += own_parts
            of += [r] * len(own_parts)
        heads = np.diff(np.array([-1, *of])).astype(np.int64)
        counted = [x for _, _, x, _ in parts]
        out = {f.name: [record[r][i] for r in of] for i, f in enumerate(own[1:])}
        out |= {"key": batch.column("key").take(pa.array(of)), "base": [x[0] for x in parts], "before": [x[1] for x in parts]}
        return out | {"counted": [x.count(b" ") + 1 for x in counted], "line": [x[3] for x in parts], "starts": word_starts([x[3] for x in parts]), "hashes": listed_hashes(counted, sizes, heads)}

    rows = map_slices(docs, "text", T.StructType([*own, *(T.StructField(n, t) for n, t in part.items())]), each)
    # each row's first hash is null: it brings the row itself, so that rows without votes stay
    grams = spark.createDataFrame(known.grams(), "hash long, template int, j int, n int, ahead int, after int")
    met = rows.select("*", F.posexplode("hashes").alias("pos", "hash")).join(F.broadcast(grams), "hash", "left").where("template IS NOT NULL OR hash IS NULL")
    skipped = F.lit(0)
    for n in sizes:
        skipped += F.when(F.col("n") > n, F.greatest(F.col("counted") - n + 1, F.lit(0))).otherwise(0)
    # the place among the part's words; the null takes the first place of a text's first part
    place = F.col("before") + F.col("pos") - F.when(F.col("base") + F.col("before") == 0, 1).otherwise(0) - skipped
    low, high = F.greatest(place - F.col("ahead"), F.lit(0)).cast("int"), F.least(place + F.col("after"), F.size("starts") - 1).cast("int")
    ids = [f.name for f in own]
    words = F.substring("line", F.col("starts")[low] + 1, F.col("starts")[high] - F.col("starts")[low] - 1)
    seen = met.select(*ids, "hash", "template", "j", *(F.when(F.col("template").isNotNull(), x).alias(n) for x, n in ((F.col("base") + place - F.col("j"), "diagonal"), (F.col("base") + low, "start"), (words, "words"))))
    votes = seen.groupBy(*ids, "template", "diagonal", "start", "words").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"), F.count(F.when(F.col("hash").isNull(), 1)).alias("copies"))
    vote = F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "bits", "start", "words"))
    return _verified(votes.groupBy(*ids).agg(F.sum("copies").alias("copies"), F.collect_list(vote).alias("votes")).drop("digest"), key, known)


def _verified(listed: DataFrame, key: str, known: Templates) -> DataFrame:
    kept = [f for f in listed.schema.fields if f.name != "votes"]
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType()), T.StructField("cover", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_type(schema)
        for batch in batches:
            labels, scores, spans = [], [], []
            for votes, base in zip(batch.column("votes").to_pylist(), batch.column("base_labels").to_pylist(), strict=True):
                found = known.spans([(v["template"], v["diagonal"], v["bits"] & (1 << 64) - 1, v["start"], v["words"]) for v in votes]) if votes else []
                labels.append(",".join(sorted({x[0] for x in found} | set(filter(None, base.split(","))))))
                scores.append(max([x[3] for x in found] + [1.0] * bool(base), default=0.0))
                spans.append([dict(zip(span.fieldNames(), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(v, types.field(n).type) for n, v in (("labels", labels), ("score", scores), ("spans", spans)))], schema=types)

    out = listed.mapInArrow(run, schema).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
    return out.withColumnRenamed("key", key)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
