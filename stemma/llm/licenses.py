"""License scans by conditional compression.

Lines with a license cue, with as many words around them as the longest template can take, are the regions that are
read. Wherever a template's rarest word stands in one, the words around it are a candidate block. Blocks that hold the
words that set the license apart are compressed, in lower case and without marks, alone and with the template as a raw
zstandard dictionary. A template is a candidate only where that makes the block shorter by REDUCED at least; candidates
are ranked by it, and in that order confirmed by the exact differences of wording: the share of the template's words, in order, that the block holds close together, and words that turn a license into
another. A finding whose words all belong to a better one, as the beginning of one license to that of another, is
dropped. Lines that carry an SPDX tag are read as such.

Edge cases: null and empty texts have no findings; a line that names a license which no template explains is reported
as unknown; long texts are scanned whole, in regions that overlap by the longest template; rows of one id are scanned
each; of findings at one place the one with most words counts, then the larger reduction, then the earlier template; an
empty table gives an empty table; columns of any name may stand beside, and are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Fixed wordings: the published texts of short licenses, the beginnings of long ones, and notices by which texts declare a license. (license, wording)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
# Names that tags use, apart from -only, -or-later and + at their end.
TAGS = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: Licenses that let a text be used for training without further terms.
PERMISSIVE = ("0BSD", "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "ISC", "CC-BY-4.0", "CC0-1.0", "Unlicense", "Zlib")
#: Words that make another license of a wording that they stand in.
MODIFIERS = {"sa", "nc", "nd", "lesser", "library", "affero"}
_CUE = re.compile(r"licen[sc]|rights reserved|copyright|public domain|permission (?:is|to)|redistribut|\bCC[ -](?:BY|0)|\bCC0\b|free software|mozilla public|spdx", re.I)
_NAMED = re.compile(r"licen[sc]ed\W+under|under\W+the\W.{1,60}?licen[sc]e", re.I | re.S)
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])?", re.I)
_TAG_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_TOKEN = re.compile(r"[A-Za-z0-9.+]*[A-Za-z0-9+]")
#: Characters of a region, the share by which a template must shorten a block, and the share of its words that confirms it.
REGION, REDUCED, CONFIRMED = 1 << 18, 0.1, 0.9


def tokens(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def between(n: int) -> int:
    """Other words that may stand among a template's n words, such as the marks of comment lines."""
    return max(2, n // 5)


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = templates
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = [self.compressor(" ".join(tokens(t))) for _, t in templates]
        self.tags = {name.lower(): (name, self.compressor(f"SPDX-License-Identifier: {name}")) for name in TAGS}
        self.words = [tokens(t) for _, t in templates]
        counts: dict[str, set[str]] = {}
        for (name, _), ws in zip(templates, self.words):
            for w in ws:
                counts.setdefault(w, set()).add(name)
        #: Words that fewer than three licenses use, and all version numbers, must be there.
        self.telling = [{w for w in ws if len(counts[w]) < 3 or any(c.isdigit() for c in w)} for ws in self.words]
        self.telling = [t or {min(ws, key=lambda w: (len(counts[w]), w))} for t, ws in zip(self.telling, self.words)]
        self.needed = [Counter(ws) for ws in self.words]
        self.reach = max(len(ws) + between(len(ws)) for ws in self.words)

    def compressor(self, template: str) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def reduction(self, block: str, given: zstandard.ZstdCompressor) -> float:
        """How much shorter the template makes the compressed block, as a share."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return (alone - len(given.compress(data))) / alone

    def widened(self, text: str, start: int, end: int) -> tuple[int, int]:
        """The span with `reach` more words on either side."""
        size = 8 * self.reach
        while True:
            low = max(0, start - size)
            ahead = [m.start() for m in _TOKEN.finditer(text, low, start)]
            if low == 0 or len(ahead) > self.reach + 1:  # the first word may be cut
                break
            size *= 2
        after = (m.start() for m in _TOKEN.finditer(text, end))
        return ahead[-self.reach - 1] if len(ahead) > self.reach else 0, next(islice(after, self.reach + 1, None), len(text))

    def regions(self, text: str) -> Iterator[tuple[int, int]]:
        """Cues with the words around them, united where they meet, in spans of about REGION characters that overlap by `reach` words."""
        at, last = None, None  # last: a cue in the region whose words after it may reach beyond
        for m in _CUE.finditer(text):
            if at is not None:
                if m.start() > at[1] and last:
                    at, last = (at[0], self.widened(text, *last)[1]), None
                if m.start() <= at[1] and at[1] - at[0] < REGION:
                    last = m.span()
                    continue
                yield (at[0], self.widened(text, *last)[1]) if last else at
            at, last = self.widened(text, *m.span()), None
        if at is not None:
            yield (at[0], self.widened(text, *last)[1]) if last else at

    def candidates(self, own: list[str]) -> list[tuple[float, int, int, int, int]]:
        """(reduction, template, place, first word, end) of blocks that a template shortens by REDUCED or more, the largest reduction first."""
        where: dict[str, list[int]] = {}
        for p, w in enumerate(own):
            where.setdefault(w, []).append(p)
        out = []
        for i, words in enumerate(self.words):
            if not self.telling[i] <= where.keys():
                continue
            n = len(words)
            anchor = min(self.telling[i], key=lambda w: (len(where[w]), w))
            first, last = words.index(anchor), n - 1 - words[::-1].index(anchor)
            for p in where[anchor]:
                low, high = max(0, p - last - between(n)), p - first + n + between(n)
                block = own[low:high]
                if self.telling[i] <= set(block) and (gain := self.reduction(" ".join(block), self.given[i])) >= REDUCED:
                    out.append((gain, i, p, low, high))
        return sorted(out, key=lambda x: (-x[0], x[1:]))

    def confirmed(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, int, float, float, frozenset[int]]]:
        """(start, end, template, reduction of the block, share of its wording, places of its words) of candidates whose words stand close together."""
        spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        own = [text[s:e].lower() for s, e in spans]
        done: dict[int, set[int]] = {}
        for gain, i, p, low, high in self.candidates(own):
            words, block = self.words[i], own[low:high]
            n = len(words)
            if p in done.get(i, ()) or (Counter(block) & self.needed[i]).total() < CONFIRMED * n:
                continue
            same = [b for b in SequenceMatcher(None, words, block, autojunk=False).get_matching_blocks() if b.size]
            while same:
                size = sum(b.size for b in same)
                if size < CONFIRMED * n:
                    break
                a, b = low + same[0].b, low + same[-1].b + same[-1].size
                if b - a - size <= between(n):
                    held = {low + x.b + k for x in same for k in range(x.size)}
                    other = {own[q] for q in range(a, b) if q not in held}
                    if self.telling[i] <= {own[q] for q in held} and not other & MODIFIERS:
                        yield spans[a][0], spans[b - 1][1], i, gain, size / n, frozenset(spans[q][0] for q in held)
                        done.setdefault(i, set()).update(range(a, b))
                    break
                same.pop(0 if same[0].size < same[-1].size else -1)  # a word far from the others

    def scan(self, text: str) -> list[dict]:
        if not _CUE.search(text):
            return []
        met = {}
        for s, e in self.regions(text):
            for a, b, i, gain, share, held in self.confirmed(text, s, e):
                met[a, b, i] = max((gain, share, held), met.get((a, b, i), (0.0, 0.0, held)), key=lambda x: x[0])
        found = [(len(held), gain, -i, a, b, share, held) for (a, b, i), (gain, share, held) in met.items()]
        kept: list[tuple[str, int, int, float, float, frozenset[int]]] = []
        by_place: dict[int, list[int]] = {}
        for size, gain, i, a, b, share, held in sorted(found, key=lambda x: x[:4], reverse=True):  # best first
            name = self.templates[-i][0]
            rivals = {k for q in held for k in by_place.get(q, ())}
            if any(held <= kept[k][5] or kept[k][0] == name for k in rivals):
                continue
            for q in held:
                by_place.setdefault(q, []).append(len(kept))
            kept.append((name, a, b, gain, share, held))
        out = [{"license": n, "start": a, "end": b, "reduction": round(g, 4), "wording": round(w, 4)} for n, a, b, g, w, _ in kept]
        known = [(f["start"], f["end"]) for f in out]
        for m in _TAG.finditer(text):
            known.append(m.span())
            names = [x for x in _TAG_NAME.findall(m[1] or "") if x.upper() not in ("AND", "OR", "WITH")]
            told = {self.tags[low][0] if (low := re.sub(r"(-only|-or-later|\+)$", "", x.lower())) in self.tags else "unknown" for x in names}
            for name in sorted(told or {"unknown"}):
                gain = self.reduction(m[0], self.tags[name.lower()][1]) if name != "unknown" else 0.0
                out.append({"license": name, "start": m.start(), "end": m.end(), "reduction": round(gain, 4), "wording": float(name != "unknown")})
        end = -1
        for m in _NAMED.finditer(text):
            a = max(text.rfind("\n", 0, m.start()) + 1, m.start() - REGION)
            b = text.find("\n", m.end())
            b = min(len(text) if b < 0 else b, m.end() + REGION)
            if a >= end and not any(s < b and a < e for s, e in known):
                out.append({"license": "unknown", "start": a, "end": b, "reduction": 0.0, "wording": 0.0})
                end = b
        return sorted(out, key=lambda f: (f["start"], f["end"], f["license"]))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses, n_findings, permissive, findings) of every row; permissive is null without findings."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    finding = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("wording", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [scanner.scan(x) if x else [] for x in batch[1].to_pylist()]
            names = [sorted({f["license"] for f in fs}) for fs in found]
            free = [all(n in PERMISSIVE for n in ns) if ns else None for ns in names]
            yield pa.record_batch([batch[0], pa.array([",".join(ns) for ns in names]), pa.array([len(fs) for fs in found], pa.int64()), pa.array(free, pa.bool_()), pa.array(found, pa.list_(finding))], names=[key, "licenses", "n_findings", "permissive", "findings"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, licenses string, n_findings long, permissive boolean, findings array<struct<license: string, start: long, `end`: long, reduction: double, wording: double>>")
