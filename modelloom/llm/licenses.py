"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts and license templates are shingled alike. For each class of template lengths, windows
of at least twice that length overlap by half, so any run as long as the template lies in
one of them. A window whose MinHash agrees with a template's in one of the bands retrieves
it; around the window, the share of the template's shingles is then counted exactly.

A match of at least ``CONTAINED`` in a window up to four times the template's length has a
Jaccard likeness above ``CONTAINED / (5 - CONTAINED)``, 0.19; one of 64 bands of one value
then agrees with a probability over 0.999998. A window without any template shingle can agree
in no band, so only windows that hold one are signed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import ROLL, in_parts, mixed, shingles, word_hashes

WORD = re.compile(r"[^\W_]+")
SHINGLE, BANDS, CONTAINED = 5, 64, 0.8

# Public notices of licenses: fixed values.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
}


def text_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingled(text: str | None) -> np.ndarray:
    return shingles(word_hashes([w.encode() for w in text_words(text)]), SHINGLE)


@dataclass(frozen=True)
class Templates:
    """Templates by name, and what is needed to find them."""

    texts: tuple[tuple[str, str], ...]

    @cached_property
    def sets(self) -> list[np.ndarray]:
        return [np.unique(shingled(text)) for _, text in self.texts]

    @cached_property
    def known(self) -> np.ndarray:
        """The shingles of all templates, sorted."""
        return np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, dtype=np.uint64)

    @cached_property
    def classes(self) -> dict[int, list[int]]:
        """From the length of windows, a power of two, to the templates that are sought with them."""
        found: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                found.setdefault(1 << (2 * len(s) - 1).bit_length(), []).append(i)
        return found

    @cached_property
    def signatures(self) -> np.ndarray:
        return np.array([signature(s) if len(s) else np.zeros(BANDS, dtype=np.uint64) for s in self.sets])

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """``(template, first word, words, containment)`` of every occurrence in a whole text."""
        found = shingled(text)
        if not len(found) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        (marked,) = np.nonzero(self.known[at] == found)
        if not len(marked):
            return []
        out = []
        for size, templates in self.classes.items():
            step = size // 2
            starts = np.unique(np.concatenate([marked // step * step, np.maximum(marked // step - 1, 0) * step]))
            retrieved: dict[int, list[int]] = {}
            for start in starts.tolist():
                window = signature(found[start : start + size])
                for t in templates:
                    if (self.signatures[t] == window).any():
                        retrieved.setdefault(t, []).append(start)
            for t, places in retrieved.items():
                out += self.verified(t, found, places, size)
        return sorted(out, key=lambda m: (m[1], m[0]))

    def verified(self, t: int, found: np.ndarray, places: list[int], size: int) -> list[tuple[int, int, int, float]]:
        """Occurrences of a template in and around the windows that retrieved it."""
        near = np.zeros(len(found), dtype=bool)
        for start in places:
            near[max(0, start - size) : start + 2 * size] = True
        (at,) = np.nonzero(near & np.isin(found, self.sets[t]))
        out, reach = [], stretch(len(shingled(self.texts[t][1])))
        while len(at):
            # From the first shingle to the last one that adds to what was found within reach.
            here = at[at < at[0] + reach]
            _, first = np.unique(found[here], return_index=True)
            here = here[: first.max() + 1]
            share = len(first) / len(self.sets[t])
            if share >= CONTAINED:
                out.append((t, int(here[0]), int(here[-1] - here[0]) + SHINGLE, share))
                at = at[len(here) :]
            else:
                at = at[1:]
        return out


def stretch(n: int) -> int:
    """Over how many shingles a notice may be stretched by words that were put in."""
    return n + n // 4


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each band's hash function."""
    seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * ROLL
    return mixed(found[None, :] ^ seeds[:, None]).min(axis=1)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, first_word, n_words, containment`` of every license notice found.

    Words are runs of letters and digits, in lower case, counted from 0. Templates of fewer
    than five words are refused. A notice that two templates share is reported
    for each that it contains to 0.8. Whole texts are read; null and empty texts have no
    match, equal rows each have theirs. Other columns are ignored. Nothing is shuffled.
    """
    known = Templates(tuple((TEMPLATES if templates is None else templates).items()))
    if short := [name for name, text in known.texts if len(text_words(text)) < SHINGLE]:
        raise ValueError(f"templates need {SHINGLE} words: {short}")
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).where(F.col("text") != "")
    kind = source.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in in_parts(batches, 1):
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for m in known.matches(text):
                    rows.append(i)
                    found.append(m)
            if rows:
                names = pa.array([known.texts[m[0]][0] for m in found], pa.string())
                numbers = [pa.array([m[k] for m in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()))]
                ids = batch.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, names, *numbers], names=["doc_id", "license", "first_word", "n_words", "containment"])

    return source.mapInArrow(scan, f"doc_id {kind}, license string, first_word long, n_words long, containment double")
