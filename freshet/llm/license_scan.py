"""License texts and notices in documents, by diagonal voting.

Every run of ``GRAM`` words of every document is hashed and joined in Spark with the places of the templates' runs. A hit at word i of a
document and word t of a template votes for the diagonal i - t. Votes of diagonals at most ``shift`` apart are merged, since words put in or left out move a
copy to a neighbouring diagonal, and bands with enough votes are verified on the words themselves: the longest common subsequence with the template has to make up ``SHARE``
of the template and of the words it spans.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import materialize, read_table
from .texts import LOWER, Batches, chunks, lean, pieces, span_hashes, windows

GRAM, SHARE = 3, 0.9
#: Documents with a band that are broadcast (some 60 bytes a band); more are joined by a shuffle.
BROADCAST_BANDS = 500_000

#: All of ASCII but digits and lower-case letters.
SPLIT = np.zeros(256, bool)
SPLIT[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: The phrases that are always found, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license texts and the notices that point to them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

Templates = Sequence[tuple[str, str]]


def words_of(text: str) -> list[bytes]:
    low = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()
    return [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def _hashed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lowered buf, start, end, row, hash) of the words."""
    low = LOWER[buf]
    start, end, row = pieces(low, offs, SPLIT)
    return low, start, end, row, span_hashes(low, start, end)


def _of(words: Sequence[bytes]) -> np.ndarray:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    return _hashed(buf, np.array([0, len(buf)]))[4]


def template_grams(spark: SparkSession, templates: Templates) -> DataFrame:
    """(gram, template, t): the hash of each run of ``GRAM`` words; a few rows a word of the templates, which are a parameter."""
    rows = []
    for k, (_, text) in enumerate(templates):
        h = _of(words_of(text))
        if len(h) < GRAM:
            raise ValueError(f"a template needs {GRAM} words or more: {text!r}")
        rows += [(int(g), k, t) for t, g in enumerate(windows(h, np.zeros(len(h), np.int64), GRAM)[0].view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, t int")


def _grams(batches: Batches) -> Batches:
    """(id, tie, text) to (id, tie, grams): the i-th hash is of the run that begins at word i."""
    for b in batches:
        for i, j, buf, offs in chunks(b.column(2)):
            _, _, _, row, h = _hashed(buf, offs)
            g, at = windows(h, row, GRAM)
            ends = np.searchsorted(row[at], np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], ["id", "tie", "grams"])


def shift_of(templates: Templates) -> int:
    """Diagonals that a copy of the longest template may cover."""
    return max(len(words_of(t)) for _, t in templates) // 9 + 1


def bands(docs: DataFrame, templates: Templates) -> DataFrame:
    """(id, tie, bands): of each text (id, hash of the text) the lowest diagonals of the bands with enough votes, with their templates."""
    rows = docs.select("id", "tie", "text").mapInArrow(lean(_grams), "id long, tie long, grams array<long>")
    hits = rows.select("id", "tie", F.posexplode("grams").alias("i", "gram")).join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")
    one = hits.select("id", "tie", "template", (F.col("i") - F.col("t")).alias("diagonal"), "i").distinct()  # repeated rows vote once
    votes = one.groupBy("id", "tie", "template", "diagonal").agg(F.count("*").alias("votes"))
    near = Window.partitionBy("id", "tie", "template").orderBy("diagonal").rangeBetween(0, shift_of(templates))
    # an edit breaks GRAM runs; of a copy that passes, fewer than a tenth of the words are left out and as many put in
    least = F.element_at(F.array(*(F.lit(max(1, int(0.35 * len(words_of(t))) - GRAM + 1)) for _, t in templates)), F.col("template") + 1)
    band = votes.withColumn("in_band", F.sum("votes").over(near)).filter(F.col("in_band") >= least)
    return band.groupBy("id", "tie").agg(F.sort_array(F.collect_list(F.struct("template", "diagonal"))).alias("bands"))


def common(template: Mapping[bytes, int], size: int, words: Sequence[bytes]) -> tuple[int, int]:
    """(length of the longest common subsequence, words up to which it is first reached); ``template`` has a bit for each place of each word."""
    every = (1 << size) - 1
    v, best, end = every, 0, 0
    for k, w in enumerate(words, 1):
        if m := template.get(w, 0):
            u = v & m
            v = ((v + u) | (v - u)) & every
            if (now := size - v.bit_count()) > best:
                best, end = now, k
    return best, end


class Verifier:
    """Aligns the words of a band with its template."""

    def __init__(self, templates: Templates):
        self.words = [words_of(t) for _, t in templates]
        self.shift = shift_of(templates)
        self.bits = [(self._masks(w), self._masks(w[::-1])) for w in self.words]

    @staticmethod
    def _masks(words: Sequence[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for k, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << k
        return out

    def align(self, template: int, diagonal: int, words: Sequence[bytes]) -> tuple[int, int, float]:
        """(first word, words, share) of the alignment in the band that begins at ``diagonal``; ``words`` are those of the document."""
        size = len(self.words[template])
        lo, hi = max(0, diagonal), min(len(words), diagonal + size + self.shift)
        there, back = self.bits[template]
        best, end = common(there, size, words[lo:hi])
        _, span = common(back, size, words[lo : lo + end][::-1])
        return lo + end - span, span, best / max(size, span)


FOUND = "array<struct<label: string, start: long, length: long, share: double>>"


def _verify(templates: Templates, phrases: Mapping[str, str]):
    want = [(_of(words_of(p)), words_of(p), label) for p, label in phrases.items()]
    fields = [pa.field("label", pa.string()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("share", pa.float64())]

    def lists(rows: list[tuple], n: int) -> pa.ListArray:
        """Rows of (row, label, start, length, share) in order of rows."""
        cols = list(zip(*rows, strict=True)) or [()] * 5
        ends = np.searchsorted(np.array(cols[0], np.int64), np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols[1:], fields, strict=True)], fields=fields))

    def run(batches: Batches) -> Batches:
        check = Verifier(templates)
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                n = j - i
                low, start, end, row, h = _hashed(buf, offs)
                first = np.searchsorted(row, np.arange(n + 1))
                base = []
                for hashes, words, label in want:
                    m = len(words)
                    hit = row[: len(row) - m + 1] == row[m - 1 :] if len(row) >= m else np.zeros(0, bool)
                    for k in range(m):
                        hit = hit & (h[k : len(h) - m + 1 + k] == hashes[k])
                    for at in np.flatnonzero(hit).tolist():
                        if all(low[start[at + k] : end[at + k]].tobytes() == w for k, w in enumerate(words)):
                            base.append((int(row[at]), label, at - int(first[row[at]]), m, 1.0))
                found = []
                spans = b.column(2).slice(i, n).to_pylist()
                for r, own in enumerate(spans):
                    if own:
                        f, l = int(first[r]), int(first[r + 1])
                        words = [low[s:e].tobytes() for s, e in zip(start[f:l].tolist(), end[f:l].tolist(), strict=True)]
                        aligned = ((templates[x["template"]][0], *check.align(x["template"], x["diagonal"], words)) for x in own)
                        found += [(r, *x) for x in sorted({x for x in aligned if x[3] >= SHARE}, key=lambda x: (x[1], x[0], x[2]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(np.diff(first)), lists(sorted(base, key=lambda x: (x[0], x[2], x[1])), n), lists(found, n)], ["id", "n_words", "base", "found"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates = TEMPLATES, phrases: Mapping[str, str] = PHRASES, broadcast_bands: int = BROADCAST_BANDS) -> DataFrame:
    """``id_col``, ``n_words``, ``base`` and ``found`` for every row, both lists of (label, start, length, share) in words.

    Words are runs of digits, lower-cased letters a-z and all characters beyond ASCII. ``base`` has every place where a phrase's words stand consecutively, ``found`` every verified copy of a template by start, label, length (a copy that
    several diagonals reach with other ends is there more than once). Null and empty texts have no words and empty lists; rows of equal id and text get
    equal results, rows that share only an id are told apart by their texts, null ids work like others; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    voted = materialize(bands(rows, templates), "license-bands")
    few = voted.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0] <= broadcast_bands
    voted = voted.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), "bands")
    both = rows.join(F.broadcast(voted) if few else voted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left")
    return both.select("id", "text", "bands").mapInArrow(lean(_verify(templates, phrases)), f"`{id_col}` long, n_words long, base {FOUND}, found {FOUND}")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    labels = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(c)["label"] for c in lists)))), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.start")).alias("first_word"), F.array_max(F.col("base.start")).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), F.coalesce(F.array_max(F.col("found.share")), F.lit(0.0)).alias("score"),
    )
