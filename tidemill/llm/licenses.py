"""License scans by conditional compression.

Candidate blocks (lines that speak of licenses, then what stands around them, as far as the longest template may reach)
are compressed by themselves and with each template as a raw dictionary; what a template saves ranks it. The best templates are confirmed by the exact
differences of wording: the template's words must stand in the block nearly in order, and those that tell
licenses apart (names, versions) must all be there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import append_columns

#: Share of the words, of a template and of the place where it stands, that must agree in order.
SHARE = 0.8
#: Least share of a block's compressed size that a template must save to be a winner.
SAVING = 0.15

#: License notices: id, words that tell it apart, text (fixed values).
TEMPLATES: list[tuple[str, str, str]] = [
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "deal sublicense", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "gnu general 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "gnu general 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "bsd 3-clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2-clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "by-sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "by-nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "by-nc-sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "cc0 1.0", "Released under CC0 1.0."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
]

SPEAKS = re.compile(r"(?i)licen[sc]|copyright|\bpublic domain\b|permission is hereby|redistribution and use|free software|\bcc[ -]?(?:by|0)\b|released under")
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
FIELDS = [("licenses", T.ArrayType(T.StringType())), ("n_candidates", T.LongType()), ("best_saving", T.LongType()), ("spans", T.ArrayType(T.LongType()))]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """Finds notices in texts. templates: (id, telling words, text)."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, share: float = SHARE, saving: float = SAVING):
        self.share, self.saving = share, saving
        self.names = [t[0] for t in templates]
        self.telling = [set(t[1].split()) for t in templates]
        self.words = [words(t[2]) for t in templates]
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
        raw = [zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for w in self.words]
        self.given = [zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in raw]
        self.seen: dict[tuple[str, ...], tuple[list[str], int, int, int]] = {}
        self.reach = max(map(len, self.words), default=0)

    def rank(self, block: list[str]) -> list[tuple[int, int]]:
        """(bytes saved, template) of the templates that save enough, most first."""
        raw = " ".join(block).encode()
        alone = len(self.plain.compress(raw))
        saved = sorted(((alone - len(c.compress(raw)), -i) for i, c in enumerate(self.given)), reverse=True)
        return [(s, -i) for s, i in saved if s >= max(4, self.saving * alone * min(1.0, len(self.words[-i]) / max(1, len(block))))]

    def confirm(self, block: list[str], template: int) -> tuple[float, int, int]:
        """Agreement of the template with the place in the block where it stands, 1 for equal words, and that place;
        0 if a telling word is missing there."""
        own = self.words[template]
        parts = [m for m in SequenceMatcher(None, own, block, autojunk=False).get_matching_blocks() if m.size]
        if not parts or not self.telling[template] <= {own[k] for m in parts for k in range(m.a, m.a + m.size)}:
            return 0.0, 0, 0
        if len(parts) > 1 and parts[0].size == 1 and parts[1].b - parts[0].b > 3:
            parts = parts[1:]  # a common word that stands far before
        if len(parts) > 1 and parts[-1].size == 1 and parts[-1].b - parts[-2].b - parts[-2].size > 3:
            parts = parts[:-1]
        first, end = parts[0].b, parts[-1].b + parts[-1].size
        return 2 * sum(m.size for m in parts) / (len(own) + end - first), first, end

    def block(self, text: list[str]) -> tuple[list[str], int, int, int]:
        """Confirmed licenses of a block's words, the best saving, and the first and end word of what is confirmed. Of
        templates that stand in one place, the one with the least differences counts."""
        key = tuple(text)
        if (known := self.seen.get(key)) is not None:
            return known
        ranked = self.rank(text)
        places, found = [], []
        close = [(*self.confirm(text, i), saved, i) for saved, i in ranked]
        for share, a, b, _, i in sorted(close, key=lambda x: (-x[0], -len(self.words[x[4]]), -x[3])):
            if share >= self.share and all(min(b, d) - max(a, c) <= 0.5 * (b - a) for c, d in places):
                places.append((a, b))
                if self.names[i] not in found:
                    found.append(self.names[i])
        made = found, ranked[0][0] if ranked else 0, min((a for a, _ in places), default=0), max((b for _, b in places), default=0)
        if len(self.seen) < 10_000 and len(text) <= 2 * self.reach:
            self.seen[key] = made
        return made

    def scan(self, text: str | None) -> tuple[list[str], int, int, list[int]]:
        if not text or not SPEAKS.search(text):
            return [], 0, 0, []
        lines = text.split("\n")
        near, flat, starts, ends = [], [], [], []
        for i, line in enumerate(lines):
            starts.append(len(flat))
            flat += words(line)
            ends.append(len(flat))
            if SPEAKS.search(line):
                near.append(i)
        found, n, best, spans, done, size = [], 0, 0, [], 0, 2 * self.reach
        for i in near:
            if ends[i] <= done:
                continue
            first, end = max(done, starts[i]), ends[i]
            tries = [(first, end)] * (end - first <= size)  # the line by itself, else with what is around it, step by step
            tries += [(k, k + size) for k in range(max(done, first - self.reach), max(first + 1, end - self.reach), self.reach)]
            for a, b in tries:
                a, block = max(a, done), flat[max(a, done) : b]
                if not block or (end - first > size and not SPEAKS.search(" ".join(block))):
                    continue
                n += 1
                names, saved, lo, hi = self.block(block)
                best = max(best, saved)
                if names:
                    found += [x for x in names if x not in found]
                    spans += [bisect_right(starts, a + lo) - 1, bisect_right(starts, a + hi - 1)]
                    done = a + hi
                    if end - first <= size:
                        break
        return found, n, best, spans

    def report(self, texts: list[str | None]) -> list[list]:
        rows = [self.scan(t) for t in texts]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """docs with licenses (confirmed ids), n_candidates (blocks tried), best_saving (bytes), spans (first and end line
    of each notice, in turn). Columns of docs with these names are replaced. Null and empty texts have none; repeated
    rows each get their answer; every line of a text is looked at, however long."""
    return append_columns(docs, FIELDS, lambda: Scanner(templates).report)
