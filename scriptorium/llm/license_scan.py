"""License scans by conditional compression.

Candidate blocks are the words, whatever their lines and comment marks, around words of which each notice must
hold one. Every block is compressed plainly and with each template's wording as a raw zstandard dictionary, and
the templates are ranked by how many bytes their dictionary saves. Down that ranking, as long as a
dictionary saves anything, the exact wording confirms a template or does not: which of its words a notice lacks or
replaces. A template whose dictionary saves nothing is not looked for.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Short public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
MENTION = r"(?i)licen[sc]e|permission is hereby|redistribution and use|free software"
#: A superset of ``MENTION`` whose words may stand on different lines.
MAY_MENTION = r"licen[sc]e|permission|redistribution|free\W+software"
#: Templates ranked for a block whose wording confirms none, and the share of a template's words that must stand in order.
RANKED = 3
#: Words that may stand between those of a notice, as a share of its template's.
WITHIN = 0.25
CONFIRM = 0.9
_OPENING = re.compile(r"^\s*(?:(?:/\*+|\*+/|\*+|//+|#+|;+|%+|--+|<!--|>+(?=\s)|\|+|(?:dnl|REM)(?=\s))\s*)+")
_CLOSING = re.compile(r"(?:\s*(?:\*+/|-->|\*+|#+|\|+))+\s*$")


def words_of(text: str) -> tuple[list[str], list[int]]:
    """The words of a text and their lines, without comment marks at either end of a line and words of
    marks only."""
    words, lines = [], []
    for number, line in enumerate(text.split("\n")):
        found = [w for w in _CLOSING.sub("", _OPENING.sub("", line)).split() if any(c.isalnum() for c in w)]
        words += found
        lines += [number] * len(found)
    return words, lines


def mentions(words: list[str]) -> list[int]:
    """The words at which a mention of a license starts."""
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    return sorted({bisect_right(starts, m.start()) - 1 for m in re.finditer(MENTION, " ".join(words))})


def anchors_of(template: list[str]) -> set[str]:
    """Words of which one at least stands in each notice that confirms the template: one more than may
    be missing, those that mention a license first, then the longest."""
    least = math.ceil(CONFIRM * len(template) - 1e-9)
    order = sorted(template, key=lambda w: (re.search(MENTION, w) is None, -len(w), w))
    return set(order[: len(template) - least + 1])


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as zstd

        raw = zstd.DICT_TYPE_RAWCONTENT
        self.plain = zstd.ZstdCompressor(level=19)
        self.words = {k: w for k, v in templates.items() if (w := words_of(v)[0])}
        self.by = {}
        for name, words in self.words.items():
            own = zstd.ZstdCompressionDict(" ".join(words).encode(), dict_type=raw)
            own.precompute_compress(level=19)
            self.by[name] = zstd.ZstdCompressor(dict_data=own)
        self.bags = {k: Counter(v) for k, v in self.words.items()}
        self.anchors = {k: anchors_of(v) for k, v in self.words.items()}
        self.longest = max(map(len, self.words.values()), default=0)
        #: How far a notice's words may lie from one of them.
        self.reach = {k: len(w) + math.floor(WITHIN * len(w)) for k, w in self.words.items()}
        self.anchored: dict[str, list[str]] = {}
        for name, anchors in self.anchors.items():
            for w in anchors:
                self.anchored.setdefault(w, []).append(name)

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """The candidate blocks: what lies within reach of an anchor of any template, joined where it meets, and cut
        again so that a block has four times the longest reach at most and each reach is whole in one."""
        near = sorted((k - self.reach[n], k + self.reach[n] + 1) for k, w in enumerate(words) for n in self.anchored.get(w, ()))
        joined: list[list[int]] = []
        for low, high in near:
            if joined and low <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([max(low, 0), high])
        step = 2 * max(self.reach.values(), default=1) + 1
        out = []
        for low, high in joined:
            high = min(high, len(words))
            out += [(k, min(k + 2 * step, high)) for k in range(low, max(low + 1, high - step), step)]
        return out

    def savings(self, block: list[str]) -> list[tuple[int, str]]:
        """(bytes saved by its dictionary, template), the largest saving first, ties by name."""
        raw = " ".join(block).encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(raw))
        return sorted(((plain - len(c.compress(raw)), k) for k, c in self.by.items()), key=lambda x: (-x[0], x[1]))

    def confirmed(self, words: list[str]) -> list[tuple[int, int, str, int]]:
        """(start, end, template, rank) of the notices whose template saves bytes in their block and whose exact wording
        stands there; rank is the template's place among the block's savings."""
        found: dict[str, dict[tuple[int, int], int]] = {}
        for low, high in self.windows(words):
            block = words[low:high]
            for rank, (saved, name) in enumerate(self.savings(block), 1):
                if saved <= 0:
                    break
                for i, j in self._notices(name, block):
                    found.setdefault(name, {}).setdefault((low + i, low + j), rank)
        out = []
        for name, spans in found.items():
            last = (-1, -1)
            for i, j in sorted(spans, key=lambda x: (x[0], -x[1])):
                if i >= last[1]:
                    last = i, j
                    out.append((i, j, name, spans[i, j]))
                elif j - i > last[1] - last[0]:  # the same notice, cut short at the end of a block
                    out[-1], last = (i, j, name, spans[i, j]), (i, j)
        return sorted(out)

    def _notices(self, name: str, words: list[str]) -> list[tuple[int, int]]:
        """The places at which a template's exact wording stands."""
        reach, found = self.reach[name], []
        for p in (k for k, w in enumerate(words) if w in self.anchors[name]):
            while not any(i <= p < j for i, j in found):
                low = max([p - reach, 0, *(j for _, j in found if j <= p)])
                high = min([p + reach + 1, len(words), *(i for i, _ in found if i > p)])
                span = self._span(name, words[low:high])
                # words further off belong to other sentences, however they are ordered
                if span is None or span[1] - span[0] > reach:
                    break
                found.append((low + span[0], low + span[1]))
        return found

    def _span(self, name: str, words: list[str]) -> tuple[int, int] | None:
        template = self.words[name]
        if sum((self.bags[name] & Counter(words)).values()) < CONFIRM * len(template):
            return None  # no order of these words can confirm it
        blocks = difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks()[:-1]
        if sum(b.size for b in blocks) / len(template) < CONFIRM:
            return None
        return blocks[0].b, blocks[-1].b + blocks[-1].size

    def wording(self, name: str, words: list[str]) -> tuple[float, list[str]]:
        """Share of the template's words in order, and the differences."""
        template = self.words[name]
        steps = difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
        same = sum(b - a for op, a, b, _, _ in steps if op == "equal")
        inner = [s for k, s in enumerate(steps) if s[0] != "equal" and not (s[0] == "insert" and k in (0, len(steps) - 1))]
        return same / len(template), [f"-{' '.join(template[a:b])} +{' '.join(words[c:d])}" for _, a, b, c, d in inner]

    def notice(self, name: str, words: list[str]) -> tuple[str, int, int, float, list[str]]:
        block = " ".join(words).encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(block))
        return (name, plain, plain - len(self.by[name].compress(block)), *self.wording(name, words))

    def blocks(self, words: list[str], lines: list[int]) -> list[tuple[int, int, int, str | None, int | None]]:
        """(line, start, end, template, rank) of the confirmed notices, and of a window without a template
        around each other mention; mentions of one line that one window holds share it."""
        out = [(lines[i], i, j, name, rank) for i, j, name, rank in self.confirmed(words)]
        spans, last = [(i, j) for _, i, j, *_ in out], (-1, -1)
        for p in mentions(words):
            if any(i <= p < j for i, j in spans) or (last[0] == lines[p] and p < last[1]):
                continue
            low = max([p - self.longest, 0, *(j for _, j in spans if j <= p)])
            high = min([p + self.longest + 1, len(words), *(i for i, _ in spans if i > p)])
            out.append((lines[p], low, high, None, None))
            last = lines[p], high
        return sorted(out, key=lambda x: x[:3])

    def scan(self, words: list[str]) -> tuple[str, int, int, float, list[str]] | None:
        """(template, plain bytes, saved bytes, share of the template's words in order, differences) of a block that
        confirms none: the best wording among the ``RANKED`` largest savings, ties by saving, then by name."""
        plain = len(self.plain.compress(" ".join(words).encode("utf-8", "surrogatepass")))
        out = [(name, plain, gain, *self.wording(name, words)) for gain, name in self.savings(words)[:RANKED] if gain > 0]
        return min(out, key=lambda x: (-x[3], -x[2], x[0]), default=None)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per block: doc_id, line, block, license, plain_bytes, saved_bytes, wording, differences,
    confirmed, rank.

    Each notice of a text is a confirmed block: ``CONFIRM`` of a template's words stand in it in order,
    however its lines are broken, and its template saves bytes of the candidate block, as the ``rank``-th of all by
    what it saves. Notices of several templates may overlap. Any other mention of
    a license is a block of the words around it, up to the next notice; its license is the template of
    the best exact wording among the ``RANKED`` largest savings, or null if no dictionary saves a byte.
    ``line`` is that of a notice's first word, or of the mention. Documents without either, null
    and empty texts have no rows; a null id is carried along; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    names = ["doc_id", "line", "block", "license", "plain_bytes", "saved_bytes", "wording", "differences", "confirmed", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        seen: dict[tuple[str | None, ...], tuple] = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found_words, lines = words_of(text)
                for line, low, high, template, rank in scanner.blocks(found_words, lines):
                    words = found_words[low:high]
                    found = seen.get((template, *words))
                    if found is None:
                        found = (scanner.scan(words) or (None, None, 0, 0.0, [])) if template is None else scanner.notice(template, words)
                        if len(seen) < 10_000:
                            seen[template, *words] = found
                    name, plain, gain, share, diffs = found
                    rows.append((doc, line, " ".join(words), name, plain, gain, share, diffs, share >= CONFIRM, rank))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    anchors = {a for t in templates.values() for a in anchors_of(words_of(t)[0]) if not re.search(f"(?i){MAY_MENTION}", a)}
    hints = "|".join([f"(?i:{MAY_MENTION})", *(re.sub(r"([^\w\s])", r"\\\1", a) for a in sorted(anchors))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(hints))
    return rows.mapInArrow(
        run, "doc_id long, line int, block string, license string, plain_bytes int, saved_bytes int, wording double, differences array<string>, confirmed boolean, rank int"
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
