"""License scan by conditional compression.

A candidate block is a run of sentences around words that licenses use (at most ``GAP`` sentences without any of them
in between, and as many after the last). A block is scanned in windows of a few times the longest template, which
overlap by more than the longest notice, so how long a block is decides nothing. Stretches of a window are compressed
alone and with every template as zstandard raw dictionary. The bytes that a template saves rank all pairs of template and
stretch; a pair that saves less than ``LEAST_SAVED`` of what the template takes itself is out, whatever its words are. The
first of the ranking names the license, unless the wording refutes it: the part of the stretch that fits best must differ
from the template in at most ``TOLERANCE`` of the template's words, and not have another number in place of one of its
numbers; the words that differ are part of the result. If it does, the next of the ranking is looked at. What the window has before and after a notice is scanned again, so several notices
in one block are all found.

Defined results: null, empty and unlicensed texts have no rows; repeated notices and repeated rows give rows each; equal
savings go to the longer template, then to the first by name, then to the first stretch; a null doc_id stays null; other columns of the input are
not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, table

# License texts and notices as their publishers word them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Distributed under the BSD license."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "GNU GPL v2"),
    ("GPL-3.0", "GNU GPL v3"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
]
# Identifiers that notices of the form "SPDX-License-Identifier: MIT" name.
SPDX = ("0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
SIGNS = ("licens", "licenc", "copyright", "rights reserved", "redistribut", "permission", "public domain", "spdx", "creative commons", "free software", "gnu gpl")
GAP = 1
TOLERANCE = 0.1
#: Share of a template's own compressed size that it has to save of a stretch.
LEAST_SAVED = 0.3
LEVEL = 12
#: Bytes of blocks whose notices a task remembers.
MEMORY = 32 << 20

_SENTENCE = re.compile(r"[^.!?:\n]*(?:[.!?:](?!\s)[^.!?:\n]*)*[.!?:]?\s*")
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the blocks that hold license words."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(s in low for s in SIGNS):
        return
    spans: list[list[int]] = []
    last = -GAP - 2
    for k, m in enumerate(_SENTENCE.finditer(low)):
        if m.end() > m.start() and any(s in m.group() for s in SIGNS):
            if k - last <= GAP + 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = k
        elif spans and k - last <= GAP:
            spans[-1][1] = m.end()
    yield from ((a, b) for a, b in spans)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.templates = sorted(templates, key=lambda t: (-len(t[1]), t))
        self.words = [[w for w, _, _ in _words(t)] for _, t in self.templates]
        make = lambda **kw: zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **kw)
        self.plain = make()
        dictionaries = [zstd.ZstdCompressionDict(t.lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT) for _, t in self.templates]
        for d in dictionaries:
            d.precompute_compress(level=LEVEL)
        self.given = [make(dict_data=d) for d in dictionaries]
        self.frame = len(self.plain.compress(b""))
        # what each template takes by itself, and the longest notice that can be one
        self.own = [max(1, len(self.plain.compress(t.lower().encode())) - self.frame) for _, t in self.templates]
        self.reach = [int(len(t) * (1 + 3 * TOLERANCE)) + 40 for _, t in self.templates]
        self.longest = max(self.reach)
        # templates of similar reach share stretches, and what those take alone
        self.widths: dict[int, list[int]] = {}
        for k, r in enumerate(self.reach):
            self.widths.setdefault(1 << (r - 1).bit_length(), []).append(k)
        self.seen: dict[str, list[tuple]] = {}
        self.held = 0

    def ranked(self, part: str) -> list[tuple[int, int, int, int]]:
        """(bytes saved, template, stretch) of all pairs that save enough, best first.

        Stretches are two reaches long and overlap by one, so every notice is whole in one of them.
        """
        out = []
        for wide, templates in self.widths.items():
            for p in range(0, max(1, len(part) - wide), wide):
                data = part[p : p + 2 * wide].lower().encode("utf-8", "replace")
                alone = len(self.plain.compress(data))
                for k in templates:
                    saved = alone - len(self.given[k].compress(data))
                    if saved >= LEAST_SAVED * self.own[k]:
                        out.append((saved, k, p, min(len(part), p + 2 * wide)))
        return sorted(out, key=lambda x: (-x[0], x[1], x[2]))

    def confirm(self, block: list[tuple[str, int, int]], k: int) -> tuple[int, int, list[str]] | None:
        """(first word, end, differing words) of the stretch that words template k, if it is near enough."""
        want, have = self.words[k], [w for w, _, _ in block]
        allowed = int(TOLERANCE * len(want))
        if (Counter(want) - Counter(have)).total() > allowed:  # words that are nowhere differ wherever the stretch lies
            return None
        pairs = [b for b in SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if b.size]
        best = None
        for i in range(len(pairs)):  # a stretch from one common run to another
            for j in range(i, len(pairs)):
                run = pairs[i : j + 1]
                a, b = run[0].a, run[-1].a + run[-1].size
                common = sum(r.size for r in run)
                differ = (len(want) - common) + (b - a - common)
                if best is None or differ < best[0]:
                    best = (differ, a, b, run)
        if best is None or best[0] > allowed:
            return None
        _, a, b, run = best
        inside = [p for r in run for p in range(r.a, r.a + r.size)]
        there = {p for r in run for p in range(r.b, r.b + r.size)}
        diff = ["+" + have[p] for p in range(a, b) if p not in set(inside)] + ["-" + w for p, w in enumerate(want) if p not in there]
        # another number is another version
        if {"+", "-"} == {w[0] for w in diff if any(c.isdigit() for c in w)}:
            return None
        return a, b, diff

    def scan(self, block: str) -> list[tuple[str, int, int, float, list[str], str]]:
        """(license, start, end, share saved, differing words, template) of each notice in a block."""
        if block in self.seen:
            return self.seen[block]
        out: list[tuple] = []
        p = 0
        while True:
            q = min(len(block), p + 4 * self.longest)
            while q < len(block) and not block[q - 1].isspace() and q - p < 5 * self.longest:
                q += 1
            final = q == len(block)
            # notices that begin in the overlap are left to the next window, where they are whole
            until = q if final else q - self.longest
            new = [(name, p + s, p + e, *more) for name, s, e, *more in self._window(block[p:q]) if p + s < until]
            out += new
            if final:
                break
            p = max([until, *(n[2] for n in new)])
            while p > until - self.longest // 2 and p > 0 and not block[p - 1].isspace() and not any(n[2] >= p for n in new):
                p -= 1
        if self.held > MEMORY:
            self.seen.clear()
            self.held = 0
        self.held += len(block)
        self.seen[block] = sorted(out, key=lambda x: x[1])
        return self.seen[block]

    def _window(self, window: str) -> list[tuple[str, int, int, float, list[str], str]]:
        out, todo = [], [(0, len(window))]
        while todo:
            a, b = todo.pop()
            for saved, k, p, q in self.ranked(window[a:b]):
                words = _words(window[a + p : a + q])
                if hit := self.confirm(words, k):
                    s, e = a + p + words[hit[0]][1], a + p + words[hit[1] - 1][2]
                    out.append((self.templates[k][0], s, e, saved / self.own[k], hit[2], self.templates[k][1]))
                    todo += [(a, s), (e, b)]
                    break
        return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, end, saved, n_diff, diff, template) of every notice; offsets count code points."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s, e in candidates(t or ""):
                    rows += [(k, name, s + x, s + y, share, len(diff), " ".join(diff), template) for name, x, y, share, diff, template in scanner.scan(t[s:e])]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "license", "start", "end", "saved", "n_diff", "diff", "template"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, license string, start long, end long, saved double, n_diff int, diff string, template string")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return scan(table(spark, sf_dir, "documents"))
