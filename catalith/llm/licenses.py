"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits, lower-cased in A-Z. The templates' runs of
GRAM words are hashed and winnowed over windows of WINDOW hashes, as those of
each document are; any common stretch of GRAM + WINDOW - 1 words shares a
fingerprint. An inverted index of the templates' fingerprints gives, for each
document, template and diagonal, where to look, unless a count of common words says that
nothing there can reach the threshold. There a local alignment within BAND words of the
diagonal finds the stretch that matches best; matched template words over all template
words is the coverage. The best match of a document is taken first and its words are
barred; the others are measured again where they reached into it, so that k copies side
by side are k matches.

Defined results: templates of fewer than GRAM words can't be found; null and
empty texts match nothing; rows with a null doc_id are scanned like others;
repeated rows are scanned one by one; matches of a document, of whatever templates,
never overlap and the best comes first (more matched words, then the larger coverage,
then the earlier); a match counts only with the words that tell its licence from
its kin (NEEDED) and without theirs (RIVAL); extra columns are ignored; an empty
table gives no rows. Templates are statements, headers and the whole texts in
`license_texts` (named -full). A stretch that drifts more than BAND words from
its diagonal is measured up to there.
"""

from __future__ import annotations

import heapq
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalith.llm import text as T
from catalith.llm.common import load

GRAM, WINDOW, BAND = 3, 3, 6
#: Stands for document words that a match has taken; pairs of equal fingerprints held at once;
#: templates of more words than SHORT are looked for in coarse windows first.
TAKEN, PIECE, SHORT = (1 << 64) - 1, 1 << 20, 64
OUT = "doc_id long, license string, matched_words long, template_words long, coverage double, start long, end long"

# The statements and headers by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Words of which a match has to hold one of each group, and words that it may not hold.
_GNU, _CC = "lesser library affero", "noncommercial sharealike noderivatives noderivs commercial nc sa nd"
NEEDED = {
    "Apache-2.0": ["apache", "2"], "Apache-2.0-header": ["apache", "2"], "MIT": ["mit"], "MPL-2.0": ["mozilla mpl", "2"],
    "GPL-2.0": ["2 v2"], "GPL-3.0": ["3 v3"], "LGPL-2.1": ["lesser", "2 v2", "1"], "LGPL-3.0": ["lesser", "3 v3"], "AGPL-3.0": ["affero", "3 v3"],
    "GPL-2.0-header": ["2 v2"], "GPL-3.0-header": ["3 v3"], "LGPL-2.1-header": ["lesser", "2 v2", "1"], "LGPL-3.0-header": ["lesser", "3 v3"], "AGPL-3.0-header": ["affero", "3 v3"],
    "CC-BY-4.0": ["4"], "CC-BY-NC-4.0": ["nc", "4"], "CC-BY-NC-4.0-long": ["noncommercial commercial", "4"], "CC-BY-SA-4.0": ["sa", "4"], "CC-BY-SA-4.0-long": ["sharealike alike", "4"],
}
RIVAL = {
    "GPL-2.0": _GNU, "GPL-2.0-header": _GNU, "GPL-3.0": _GNU, "GPL-3.0-header": _GNU, "GPL-3.0-full": "remotely",
    "CC-BY-4.0": _CC, "CC-BY-NC-4.0": "sa nd", "CC-BY-NC-4.0-long": "sharealike noderivatives noderivs", "CC-BY-SA-4.0": "nc nd", "CC-BY-SA-4.0-long": "noncommercial",
    "BSD-2-Clause-full": "neither endorse",
}


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """TEMPLATES and the whole texts shipped with the package; read by the driver."""
    return TEMPLATES | {f"{f.stem}-full": f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def winnow(found: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Places in `found` that winnowing keeps: the least hash of each window of a row (the
    rightmost of equal ones); rows of fewer hashes than a window keep their least one."""
    if not len(found):
        return np.zeros(0, np.int64)
    starts = np.searchsorted(row, np.arange(n + 1))
    last = starts[row + 1] - 1
    keep = np.zeros(len(found), bool)
    at = np.arange(len(found))
    whole = (at + WINDOW - 1 <= last) | (at == starts[row])
    best, low = at.copy(), found.copy()
    for j in range(1, WINDOW):
        other = np.minimum(at + j, last)
        better = found[other] <= low
        best, low = np.where(better, other, best), np.where(better, found[other], low)
    keep[best[whole]] = True
    return np.flatnonzero(keep)


def align(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of template words with document words within band of the
    diagonal (document place - template place): matched words, first and last document
    place. Match 2, substitution -1, gap -1; ties: the earlier end, then the later start. No
    alignment reaches over a TAKEN word."""
    if 0 <= diagonal <= len(doc) - len(template) and (doc[diagonal : diagonal + len(template)] == template).all():
        return len(template), diagonal, diagonal + len(template) - 1
    width = 2 * band + 1
    low = diagonal - band
    window = doc[max(0, low) : max(0, diagonal + len(template) + band)].tolist()
    at_end, base = len(window), low - max(0, low)
    value, matched, first = [0] * (width + 1), [0] * (width + 1), [-1] * (width + 1)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        left, left_m, left_s = 0, 0, -1
        for k in range(width):
            p = i + base + k  # place in the window
            v, m, s = 0, 0, -1
            if 0 <= p < at_end and (seen := window[p]) != TAKEN:
                if seen == word:
                    v, m = value[k] + 2, matched[k] + 1
                    s = first[k] if matched[k] else p
                elif value[k] > 1:
                    v, m, s = value[k] - 1, matched[k], first[k]
                if value[k + 1] > 1 and (value[k + 1] - 1, matched[k + 1], first[k + 1]) > (v, m, s):
                    v, m, s = value[k + 1] - 1, matched[k + 1], first[k + 1]
                if left > 1 and (left - 1, left_m, left_s) > (v, m, s):
                    v, m, s = left - 1, left_m, left_s
                if v > best[0]:
                    best = (v, m, s, p)
            value[k], matched[k], first[k] = left, left_m, left_s = v, m, s
        value[width], matched[width], first[width] = 0, 0, -1
    return best[1], best[2] + max(0, low), best[3] + max(0, low)


def reach(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> int:
    """No alignment within band of the diagonal matches more template words than this."""
    padded = np.arange(len(template)) + diagonal
    hit = np.zeros(len(template), bool)
    for k in range(-band, band + 1):
        lo, hi = np.searchsorted(padded, (-k, len(doc) - k))
        hit[lo:hi] |= doc[padded[lo:hi] + k] == template[lo:hi]
    return int(hit.sum())


def reaches(doc: np.ndarray, template: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> np.ndarray:
    """reach of each diagonal; of many diagonals and a short template all at once."""
    if len(diagonals) < len(template):
        return np.array([reach(doc, template, d, band) for d in diagonals.tolist()], np.int64)
    pad = len(template) + 2 * band
    edge = np.full(pad, TAKEN, T.U)
    wide = np.concatenate((edge, doc, edge))
    total = np.zeros(len(diagonals), np.int64)
    at = np.clip(diagonals, -len(template) - band, len(doc) + band) + pad
    for i, word in enumerate(template):
        hit = np.zeros(len(diagonals), bool)
        for k in range(-band, band + 1):
            hit |= wide[at + i + k] == word
        total += hit
    return total


def possible(doc: np.ndarray, template: np.ndarray, diagonals: np.ndarray, least: float, band: int = BAND) -> np.ndarray:
    """The diagonals about which enough words of the template stand, in whatever order: words
    are counted in windows that hold a sixteenth of the template more."""
    if len(template) <= SHORT:
        return diagonals
    vocabulary, wanted = np.unique(template, return_counts=True)
    spot = np.minimum(np.searchsorted(vocabulary, doc), len(vocabulary) - 1)
    number = np.where(vocabulary[spot] == doc, spot, len(vocabulary))
    step = len(template) // 16
    cell, of = np.unique(diagonals // step, return_inverse=True)
    held = [np.minimum(np.bincount(number[max(0, c * step - band) : max(0, (c + 1) * step + len(template) + band)], minlength=len(wanted) + 1)[:-1], wanted).sum() for c in cell.tolist()]
    return diagonals[(np.array(held) >= least)[of]]


def taken(doc: np.ndarray, looks: list[tuple[int, np.ndarray]], index: dict, threshold: float):
    """(template, matched words, first, last place) of a document's matches, the best first.
    `looks`: templates and the diagonals where they may stand."""
    doc, heap = doc.copy(), []
    barred = np.zeros(len(doc), bool)
    around = lambda of, d: barred[max(0, d - BAND) : max(0, d + len(index["words"][of]) + BAND)].sum()

    def offer(of: int, d: int, most: int) -> None:
        if most >= threshold * len(index["words"][of]):
            heapq.heappush(heap, (-most, -most / len(index["words"][of]), -1, -1, of, d, None))

    for of, diagonals in looks:
        template = index["words"][of]
        for d, most in zip(diagonals.tolist(), reaches(doc, template, diagonals).tolist(), strict=True):
            offer(of, d, most)
    while heap:
        minus, _, first, last, of, d, seen = heapq.heappop(heap)
        template, (needed, rival) = index["words"][of], index["tells"][of]
        if seen is None:  # not aligned yet
            matched, first, last = align(doc, template, d)
            held = doc[first : last + 1]
            if matched >= threshold * len(template) and all(np.isin(x, held).any() for x in needed) and not np.isin(rival, held).any():
                heapq.heappush(heap, (-matched, -matched / len(template), first, last, of, d, around(of, d)))
            continue
        if seen == around(of, d):
            yield of, -minus, first, last
            barred[first : last + 1], doc[first : last + 1] = True, TAKEN
        offer(of, d, reach(doc, template, d))


def _hashed(some: list[str]) -> np.ndarray:
    raw, offsets = T.flat(pa.array(some, pa.string()))
    return T.words(raw, offsets, T.PLAIN)[0]


def _index(templates: dict[str, str]) -> dict:
    names = sorted(templates)
    raw, offsets = T.flat(pa.array([templates[x] for x in names]))
    hashes, row, _, _ = T.words(raw, offsets, T.PLAIN)
    found, at = T.grams(hashes, row, GRAM)
    kept = winnow(found, row[at], len(names))
    bounds = np.searchsorted(row, np.arange(len(names) + 1))
    order = kept[np.argsort(found[kept], kind="stable")]
    tells = [([_hashed(x.split()) for x in NEEDED.get(n, [])], _hashed(RIVAL.get(n, "").split())) for n in names]
    return {"names": names, "tells": tells, "words": [hashes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], "hash": found[order], "of": row[at][order], "place": at[order] - bounds[row[at][order]]}


def looks(index: dict, found: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows (doc, template, diagonal), ascending, of every fingerprint that a template has too."""
    left = np.searchsorted(index["hash"], found, "left")
    times = np.searchsorted(index["hash"], found, "right") - left
    some = np.flatnonzero(times)
    left, times, doc, place = left[some], times[some], doc[some], place[some]
    size, shift = len(index["words"]), max(map(len, index["words"]), default=0)
    width = int(place.max(initial=0)) + shift + 1
    parts = [np.zeros(0, np.int64)]
    for lo, hi in T.slices(np.concatenate(([0], np.cumsum(times))), PIECE):
        n = times[lo:hi]
        hit = np.repeat(left[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts.append(np.unique((np.repeat(doc[lo:hi], n) * size + index["of"][hit]) * width + np.repeat(place[lo:hi], n) - index["place"][hit] + shift))
    pair, diagonal = np.divmod(np.unique(np.concatenate(parts)), width)
    return np.stack((pair // size, pair % size, diagonal - shift), 1)


def matches(index: dict, threshold: float, raw: np.ndarray, offsets: np.ndarray):
    """(row, template, matched words, start, end in code points) of each match in a slice of texts."""
    hashes, row, starts, ends = T.words(raw, offsets, T.PLAIN)
    found, at = T.grams(hashes, row, GRAM)
    kept = winnow(found, row[at], len(offsets) - 1)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    at = at[kept]
    spots = looks(index, found[kept], row[at], at - bounds[row[at]])
    cuts = np.append(np.flatnonzero(np.diff(spots[:, 0], prepend=-1)), len(spots))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        doc = int(spots[lo, 0])
        words, where = hashes[bounds[doc] : bounds[doc + 1]], []
        for of in np.unique(spots[lo:hi, 1]).tolist():
            template = index["words"][of]
            if len(words) < threshold * len(template):
                continue
            diagonals = spots[lo:hi, 2][spots[lo:hi, 1] == of]
            apart = 1 + min(BAND // 2, (len(template) - 1) // 2)  # the band about one diagonal holds its neighbours
            diagonals = diagonals[np.unique(diagonals // apart, return_index=True)[1]]
            where.append((of, possible(words, template, diagonals, threshold * len(template))))
        chars = None
        for of, matched, first, last in sorted(taken(words, where, index, threshold), key=lambda x: x[2]):
            if chars is None:
                chars = np.concatenate(([0], np.cumsum((raw[offsets[doc] : offsets[doc + 1]] & 0xC0) != 0x80)))
            a, b = (int(x) - int(offsets[doc]) for x in (starts[bounds[doc] + first], ends[bounds[doc] + last]))
            yield doc, of, matched, int(chars[a]), int(chars[b])


def _scan(index: dict, threshold: float):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def each(batches):
        for batch in batches:
            docs, rows = batch.column(0), []
            raw, offsets = T.flat(batch.column(1))
            for lo, hi in T.slices(offsets) if len(index["hash"]) else ():
                for doc, of, matched, start, end in matches(index, threshold, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    size = len(index["words"][of])
                    rows.append((docs[lo + doc].as_py(), index["names"][of], matched, size, matched / size, start, end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return each


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row for each match: doc_id, license, matched_words, template_words, coverage, and
    start and end in code points (end exclusive). `templates` is a configured, bounded table."""
    return docs.select("doc_id", "text").mapInArrow(_scan(_index(templates or all_templates()), threshold), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))
