"""License scan: MinHash over overlapping windows finds templates, containment of shingles confirms them.

A text is a sequence of three-word shingles.  Windows of 8, 16, 32, ... shingles
slide by a quarter of their length (half for the shortest); a template is
sought among windows of the smallest length that some window must cover it
whole.  So the similarity of template and window is at least about 3/8, and one
of 24 bands of one MinHash value collides with probability
1 - (5/8)^24 > 0.99998.  A retrieved template is reported where the window
holds at least ``CONTAINMENT`` of its distinct shingles.

The templates are a parameter, bounded by ``MAX_TEMPLATES``, and go to every
task; no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, raw_texts, shingles, slices
from .decontaminate import tokens

SHINGLE = 3
BANDS = 24
BLOCK = 4
CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000

#: short notices and the opening paragraphs of public licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Apache-2.0 header": (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software '
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        'either express or implied.'),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    "GPL-3.0 header": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General '
        'Public License as published by the Free Software Foundation, either version 3 of the License, or (at your '
        'option) any later version.'),
    "BSD text": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that '
        'the following conditions are met: Redistributions of source code must retain the above copyright notice, this '
        'list of conditions and the following disclaimer.'),
}

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hash(shingle_hashes: np.ndarray, band: int) -> np.ndarray:
    return mix(shingle_hashes ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def window_length(n_shingles: int) -> int:
    """Shortest window, in shingles, that covers any run of ``n_shingles`` at its slide."""
    length = 2 * BLOCK
    while length - slide(length) + 1 < n_shingles:
        length *= 2
    return length


def slide(length: int) -> int:
    return max(BLOCK, length // 4)


class Index:
    """Shingle sets of the templates and their MinHash values per window length and band."""

    def __init__(self, templates: Mapping[str, str]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.names, self.sets, lengths = [], [], []
        for name, text in templates.items():
            values, counts = tokens([text.encode()])
            if counts[0] < SHINGLE:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            found, _ = shingles(values, counts, SHINGLE)
            self.names.append(name)
            self.sets.append(np.unique(found))
            lengths.append(window_length(len(found)))
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for length in sorted(set(lengths)):
            members = np.array([i for i, x in enumerate(lengths) if x == length])
            per_band = []
            for band in range(BANDS):
                least = np.array([_hash(self.sets[i], band).min() for i in members], np.uint64)
                order = np.argsort(least, kind="stable")
                maybe = np.zeros(1 << 16, bool)
                maybe[(least & np.uint64(0xFFFF)).astype(np.int64)] = True
                per_band.append((least[order], members[order], maybe))
            self.bands[length] = per_band

    def candidates(self, padded: np.ndarray) -> set[tuple[int, int, int]]:
        """(window start, window length, template) where a band collides; ``padded`` fills whole blocks."""
        found: set[tuple[int, int, int]] = set()
        empty = padded == _MAX
        for band in range(BANDS):
            blocks = np.where(empty, _MAX, _hash(padded, band)).reshape(-1, BLOCK).min(axis=1)
            width, least = 1, blocks
            for length, per_band in self.bands.items():
                while width * BLOCK < length:
                    more = least.copy()
                    if len(least) > width:
                        more[:-width] = np.minimum(least[:-width], least[width:])
                    least, width = more, width * 2
                step = slide(length) // BLOCK
                windows = least[::step]
                values, members, maybe = per_band[band]
                for w in np.flatnonzero(maybe[(windows & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                    low, high = np.searchsorted(values, windows[w], "left"), np.searchsorted(values, windows[w], "right")
                    found.update((w * step * BLOCK, length, int(t)) for t in members[low:high])
        return found


def _scan(index, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                values, counts = tokens(raw_texts(batch.column("text")))
                found, per_text = shingles(values, counts, SHINGLE)
                # every text starts on the grid of all windows, and filler parts it from the next one, so what is
                # found does not depend on its neighbours
                longest = max(known.bands, default=BLOCK)
                grain = slide(longest)
                room = np.where(per_text > 0, -(-per_text // grain) * grain + longest, 0)
                begin = np.cumsum(room) - room
                padded = np.full(int(room.sum()), _MAX)
                owner = np.repeat(np.arange(len(per_text)), per_text)
                place = np.arange(len(found)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + begin[owner]
                padded[place] = found
                belongs = np.repeat(np.arange(len(per_text)), room)
                hits: dict[tuple[int, int], tuple[float, int]] = {}
                for start, length, template in known.candidates(padded) if len(padded) else ():
                    wanted = known.sets[template]
                    part = padded[start: start + length]
                    at = start + np.flatnonzero(np.isin(part, wanted))
                    for text in np.unique(belongs[at]).tolist():
                        own = at[belongs[at] == text]
                        share = len(np.unique(padded[own])) / len(wanted)
                        if share >= containment:
                            first = int(own[0] - begin[text])
                            best = hits.get((text, template), (0.0, first))
                            hits[text, template] = max(best, (share, first), key=lambda x: (x[0], -x[1]))
                rows = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([t for t, _ in rows], pa.int64())),
                     pa.array([known.names[k] for _, k in rows], pa.string()),
                     pa.array([hits[r][0] for r in rows], pa.float64()),
                     pa.array([hits[r][1] for r in rows], pa.int64())],
                    names=["doc_id", "license", "containment", "first_word"])

    return run


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """License notices in ``docs`` (``doc_id``, ``text``): ``doc_id``, ``license``, ``containment``, ``first_word``.

    One row per document and template, with its best window; ``first_word`` is
    where the match begins.  NULL and empty texts hold none; repeated rows each
    report; an empty table gives an empty result; other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan(index, containment), "doc_id long, license string, containment double, first_word long")


def licenses_per_document(docs: DataFrame, templates: Mapping[str, str] | None = None,
                          containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: ``doc_id``, ``licenses`` (sorted names, separated by ``;``), ``n_licenses``."""
    found = scan(docs, templates, containment).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("license")).alias("_names"))
    return docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left").select(
        "doc_id", F.coalesce(F.concat_ws(";", "_names"), F.lit("")).alias("licenses"),
        F.coalesce(F.size("_names"), F.lit(0)).alias("n_licenses"))
