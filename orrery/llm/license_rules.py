"""Licence scans by sentence-rule recognition.

Texts are cut into sentences, in three ways: at full stops only, as in wrapped licence texts;
at line ends as well, as in notices that stand alone; and at full stops, blank lines and
colons before a line end, as in notices below a title or above a list.  A sentence is normalised to its
words, without case and punctuation; known ones have identifiers.  A licence rule is a
sequence of identifiers; it matches where its identifiers follow each other in a document, in
order, with at most ``MAX_GAP`` other words between two, whether known sentences or not.  A rule
whose match lies inside a longer rule's is left out.

Scale: a map over the documents without a shuffle; the rules are broadcast with the code.
Edge cases: null and empty texts have no licence; equal rows have equal licences; a repeated
notice is matched each time and named once; of several matches of a rule from one sentence the
nearest is taken; a text of any length is scanned whole; an empty table has no rows.  Columns other
than the key and the text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as w
from .stages import lean

MAX_GAP = 40

#: Licence name and its sentences in order; a licence may have several rules.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("Released under the MIT License",)),
    ("MIT", ("Licensed under the MIT License",)),
    ("MIT", ("This project is licensed under the MIT License",)),
    (
        "MIT",
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software',
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        ),
    ),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0",)),
    (
        "Apache-2.0",
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
            "See the License for the specific language governing permissions and limitations under the License",
        ),
    ),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3",)),
    ("GPL-3.0", ("Licensed under the GNU General Public License v3.0",)),
    (
        "GPL-3.0-or-later",
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
            "See the GNU General Public License for more details",
        ),
    ),
    (
        "GPL-2.0-or-later",
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
            "See the GNU General Public License for more details",
        ),
    ),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0",)),
    ("CC-BY-NC-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0",)),
    ("CC0-1.0", ("Released under CC0 1.0",)),
    ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain",)),
    (
        "BSD",
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ),
    ),
    (
        "AGPL-3.0-or-later",
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
            "See the GNU Affero General Public License for more details",
        ),
    ),
    (
        "LGPL-2.1-or-later",
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
            "See the GNU Lesser General Public License for more details",
        ),
    ),
    (
        "Zlib",
        (
            "This software is provided 'as-is', without any express or implied warranty",
            "In no event will the authors be held liable for any damages arising from the use of this software",
        ),
    ),
    (
        "0BSD",
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
        ),
    ),
    ("MIT", ("SPDX-License-Identifier: MIT",)),
    ("Apache-2.0", ("SPDX-License-Identifier: Apache-2.0",)),
    ("BSD", ("SPDX-License-Identifier: BSD-3-Clause",)),
    ("BSD", ("SPDX-License-Identifier: BSD-2-Clause",)),
    ("GPL-2.0-or-later", ("SPDX-License-Identifier: GPL-2.0-or-later",)),
    ("GPL-3.0-or-later", ("SPDX-License-Identifier: GPL-3.0-or-later",)),
    ("LGPL-2.1-or-later", ("SPDX-License-Identifier: LGPL-2.1-or-later",)),
    ("MPL-2.0", ("SPDX-License-Identifier: MPL-2.0",)),
    ("CC-BY-4.0", ("SPDX-License-Identifier: CC-BY-4.0",)),
    ("CC0-1.0", ("SPDX-License-Identifier: CC0-1.0",)),
    (
        "MIT",  # as above, cut at the colon
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        ),
    ),
)

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_BLANK = ~w.SPACED


@dataclass
class Sentences:
    """Of a chunk: row, first and end word (within the row) and hash of each sentence."""

    row: np.ndarray
    first: np.ndarray
    end: np.ndarray
    hashed: np.ndarray


def sentences(chunk: w.Chunk) -> Iterator[Sentences]:
    """In each of the three ways.  A full stop, question or exclamation mark before white space or the end is a stop, but not that of a "v." before a number."""
    data = chunk.data
    starts, ends, firsts = w.spans(chunk, w.ALNUM)
    if not len(starts):
        return
    follows = np.ones(len(data), bool)
    follows[:-1] = _BLANK[data[1:]]
    last = chunk.bounds[1:][np.diff(chunk.bounds) > 0] - 1
    follows[last] = True

    def between(marks: np.ndarray) -> np.ndarray:
        """How many marks are behind each word and before the next."""
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[starts[1:]] - sums[ends[:-1]]

    stops = between(_STOP[data] & follows)
    version = (ends - starts == 1)[:-1] & (data[starts[:-1]] | 32 == ord("v")) & (data[ends[:-1]] == ord("."))
    version &= (data[starts[1:]] >= ord("0")) & (data[starts[1:]] <= ord("9"))
    stop = stops > version
    lines, colons = between(data == 10), between(data == ord(":"))
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    other = row[1:] != row[:-1]
    hashed = w.hashes(data, starts, ends)
    up, down = w.powers(len(hashed) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[: len(hashed)])])
    for cut in (stop, stop | (lines > 0), stop | (lines > 1) | ((lines > 0) & (colons > 0))):
        first = np.flatnonzero(np.concatenate([[True], cut | other]))
        end = np.concatenate([first[1:], [len(starts)]])
        folded = w.mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
        base = firsts[:-1][row[first]]
        yield Sentences(row[first], first - base, end - base, folded)


class Rules:
    def __init__(self, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> None:
        known: dict[int, int] = {}
        self.rules: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
        for name, texts in rules:
            column = pa.array([f"{t}." for t in texts])
            sequence = []
            for chunk in w.chunks(column, lower=True):
                for x in _whole(chunk):
                    sequence.append(known.setdefault(x, len(known)))
            self.rules.setdefault(sequence[0], []).append((name, tuple(sequence)))
        self.hashes = np.array(sorted(known), np.uint64)
        self.ids = np.array([known[int(x)] for x in self.hashes], np.int64)

    def identify(self, chunk: w.Chunk) -> list[tuple[int, int, int, int]]:
        """Row, first word, end word and identifier of each known sentence, in order."""
        found = set()
        for s in sentences(chunk):
            place = np.searchsorted(self.hashes, s.hashed)
            place[place == len(self.hashes)] = 0
            hit = np.flatnonzero(self.hashes[place] == s.hashed)
            found.update(zip(s.row[hit].tolist(), s.first[hit].tolist(), s.end[hit].tolist(), self.ids[place[hit]].tolist(), strict=True))
        return sorted(found)

    def match(self, line: list[tuple[int, int, int]], gap: int = MAX_GAP) -> list[tuple[str, int, int]]:
        """Licence, first and end word of each match in a document's (first, end, identifier) sentences; none inside a longer one."""
        out, firsts = [], [x[0] for x in line]
        for first, behind, identifier in line:
            for name, sequence in self.rules.get(identifier, ()):
                end = behind
                for wanted in sequence[1:]:
                    # The next such sentence within the gap; other known ones may stand before it.
                    at, upto = bisect_left(firsts, end), bisect_right(firsts, end + gap)
                    found = next((x for x in line[at:upto] if x[2] == wanted), None)
                    if found is None:
                        break
                    end = found[1]
                else:
                    out.append((name, first, end))
        reach, kept = -1, []
        for m in sorted(out, key=lambda m: (m[1], -m[2], m[0])):
            if m[2] > reach:
                kept.append(m)
                reach = m[2]
        return kept


def _whole(chunk: w.Chunk) -> list[int]:
    """Each row as one sentence, whatever marks are inside."""
    starts, ends, firsts = w.spans(chunk, w.ALNUM)
    hashed = w.hashes(chunk.data, starts, ends)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        up, _ = w.powers(int(b - a) + 1)
        total = (hashed[a:b] * up[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        out.append(int(w.mix(np.array([total], np.uint64))[0]))
    return out


def _scan(rules: Sequence[tuple[str, Sequence[str]]], gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for batch in lean(batches):
            for chunk in w.chunks(batch.column(1), lower=True):
                by_row: dict[int, list[tuple[int, int, int]]] = {}
                for row, first, end, identifier in known.identify(chunk):
                    by_row.setdefault(row, []).append((first, end, identifier))
                n = chunk.last - chunk.first
                matches = [known.match(by_row[r], gap) if r in by_row else [] for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, n),
                        pa.array([sorted({m[0] for m in found}) for found in matches], pa.list_(pa.string())),
                        pa.array([[{"license": m[0], "first_word": m[1], "end_word": m[2]} for m in found] for found in matches], _MATCHES),
                    ],
                    ["doc_id", "licenses", "matches"],
                )

    return run


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def scan(
    docs: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = RULES, key: str = "doc_id", text: str = "text", gap: int = MAX_GAP
) -> DataFrame:
    """doc_id, licenses (sorted names) and matches (licence, first and end word) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(tuple(rules), gap),
        f"doc_id {kind}, licenses array<string>, matches array<struct<license: string, first_word: long, end_word: long>>",
    )
