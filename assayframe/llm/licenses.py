"""License scans by conditional compression.

Candidate blocks are the words around every place where a notice can be. Each block is compressed with every template as a raw
zstandard dictionary, and the templates are ranked by how much smaller the block gets. In this order they are confirmed by exact
wording: for each place of the block the fewest words to add, drop or replace so that the template ends there, at most a quarter of the
template's words. Words that decide (names, versions, variants) must be the template's own. Of confirmed parts that share words the one whose
template ranks higher stays; no template is left out, so all others are found, however many a line has. Where the name fits and the
version does not, the finding names the family and says that the version is another one.

Blocks lose nothing: a part that differs from a template in at most ``most`` words has at least one of any ``most + 1`` of its words, and has all
deciding ones, so every part holds a cue word of its template. The cues are such words, the rarest among the templates, and a block
reaches as far around each as the longest template can.

Edge cases: null and empty texts have no findings. Repeated rows each get the finding. Case, marks and line ends do not
matter. Long licenses are known by their title, header and paragraphs. A two or three clause license is told by which of its clauses
stand in the text; the opening alone counts as the three-clause one. Ids after an SPDX tag are read one by one. Ties go to fewer differing words, then to the first by name. An empty table
gives an empty result. Every finding is a function of one row, so the plan has no shuffle and no key that could run hot.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import WORD

#: Most differing words for each template word.
MAX_DIFFERENT = 0.25
LEVEL = 9

GNU = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as "
       "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
GNU_ONLY = "it under the terms of the GNU {}General Public License version {} as published by the Free Software Foundation."
GNU_TITLE = "GNU {}General Public License Version {}, {} Copyright (C) {} Free Software Foundation, Inc."
CREATIVE = "This work is licensed under {} Creative Commons {} 4.0 International License."
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
         "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")

#: The wording by which licenses are announced: sentences, file headers, and the paragraphs or title of the full text.
TEMPLATES = {
    "AGPL-3.0": [GNU.format(":", "Affero ", "3"), GNU_TITLE.format("Affero ", "3", "19 November 2007", "2007")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD clause": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", CREATIVE.format("the", "Attribution"), "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", CREATIVE.format("the", "Attribution-NonCommercial"),
                     "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", CREATIVE.format("the", "Attribution-NonCommercial-NoDerivatives"),
                        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", CREATIVE.format("the", "Attribution-NonCommercial-ShareAlike"),
                        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", CREATIVE.format("the", "Attribution-NoDerivatives"),
                     "Creative Commons Attribution-NoDerivatives 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", CREATIVE.format("the", "Attribution-ShareAlike"),
                     "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal",
                "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, Version 2.0.", "Eclipse Public License - v 2.0",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", GNU.format(";", "", "2"), GNU_ONLY.format("", "2"),
                "GNU General Public License, version 2", GNU_TITLE.format("", "2", "June 1991", "1989, 1991")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", GNU.format(":", "", "3"), GNU_ONLY.format("", "3"),
                "GNU General Public License, version 3", GNU_TITLE.format("", "3", "29 June 2007", "2007")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."],
    "LGPL-2.1": [GNU.format(";", "Lesser ", "2.1"), "GNU Lesser General Public License, version 2.1", GNU_TITLE.format("Lesser ", "2.1", "February 1999", "1991, 1999")],
    "LGPL-3.0": [GNU.format(":", "Lesser ", "3"), "GNU Lesser General Public License, version 3", GNU_TITLE.format("Lesser ", "3", "29 June 2007", "2007")],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Permission is hereby granted, free of charge, to any person obtaining a copy",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", AS_IS],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely, subject to the following restrictions:", "Licensed under the zlib License."],
}
#: Words that tell licenses apart, besides versions.
NAMES = {
    "affero", "apache", "attribution", "attribution-noncommercial", "attribution-noncommercial-noderivatives", "attribution-noncommercial-sharealike",
    "attribution-noderivatives", "attribution-sharealike", "boost", "by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "cc", "cc0", "creative", "eclipse",
    "gnu", "isc", "lesser", "library", "mit", "mozilla", "unlicense", "zlib",
}
VERSION = re.compile(r"v?(\d{1,2}(?:\.\d+)*?)(?:\.0)*$")
#: License ids after an SPDX tag, in lower case; a GNU id may end in -only, -or-later or +.
SPDX = {name.lower(): name for name in [*TEMPLATES, "BSD-2-Clause"] if name not in ("Proprietary", "BSD", "BSD clause")}
SPDX |= {f"{low}-{end}": name for low, name in list(SPDX.items()) if "GPL" in name for end in ("only", "or-later")}
TAG = "spdx-license-identifier"
TOKEN = re.compile(r"\w+(?:[.-]\w+)*")


def wording(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def names_in(words: list[str], template: frozenset[str]) -> Counter:
    """Deciding names; a small word such as "by" decides only in templates that use it so."""
    return Counter(w for w in words if w in NAMES and (w != "by" or "cc" in template))


def versions_in(words: list[str]) -> Counter:
    return Counter(m[1] for w in words if (m := VERSION.match(w)))


class Template:
    def __init__(self, license: str, text: str):
        self.license, self.words = license, wording(text)
        self.text, self.counts = " ".join(self.words), Counter(self.words)
        self.most = int(MAX_DIFFERENT * len(self.words))
        self.have = frozenset(self.words)
        self.names, self.versions = names_in(self.words, self.have), versions_in(self.words)
        self.cues: set[str] = set()

    def agrees(self, words: list[str]) -> tuple[bool, bool]:
        """Whether a part has the template's own names, and its versions."""
        return names_in(words, self.have) == self.names, versions_in(words) == self.versions


ALL = [Template(name, text) for name, texts in TEMPLATES.items() for text in texts]


def _set_cues() -> dict[str, int]:
    """Cues of each template: one name that it must have, or else its ``most + 1`` rarest words, each place of a word counted."""
    uses = Counter(w for t in ALL for w in t.have)
    rare = lambda w: (len(w) < 5, uses[w], -len(w), w)
    reach: dict[str, int] = {}
    for t in ALL:
        names = [w for w in t.names if w != "by"]
        if names:
            t.cues = {min(names, key=rare)}
        else:
            t.cues = set(sorted(t.words, key=rare)[:t.most + 1])
        for w in t.cues:
            reach[w] = max(reach.get(w, 0), len(t.words) + t.most)
    return reach


#: Words around a cue that a part with it can reach.
REACH = _set_cues() | {TAG: 24}
CODES = {w: i for i, w in enumerate(sorted({w for t in ALL for w in t.words}))}


def ends(block: np.ndarray, template: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a block, the differences of the part ending there that fits the template best, and its start."""
    n, one = len(block), np.int64(1) << 32
    along = np.arange(n + 1, dtype=np.int64) * one
    best = n - np.arange(n + 1, dtype=np.int64)  # differences in the high half; in the low half, less for a later start
    for word in template:
        new = best + one
        np.minimum(new[1:], best[:-1] + np.where(block == CODES[word], 0, one), out=new[1:])
        best = np.minimum.accumulate(new - along) + along
    return best >> 32, n - (best & (one - 1))


@functools.lru_cache(256)
def compressor(template: str | None) -> zstandard.ZstdCompressor:
    given = template and zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, **({"dict_data": given} if given else {}))


def saved(block: str, template: str) -> int:
    """Bytes by which a block gets smaller with the template as a dictionary."""
    data = block.encode()
    return len(compressor(None).compress(data)) - len(compressor(template).compress(data))


@functools.lru_cache(10_000)
def reduction(part: str, template: str) -> float:
    """How much smaller a part gets with the template as a dictionary."""
    return saved(part, template) / len(compressor(None).compress(part.encode()))


def tagged(words: list[str]) -> Iterator[tuple[int, str]]:
    """The place and license of each known id of the expressions after SPDX tags."""
    for at in (i for i, w in enumerate(words) if w == TAG):
        joined = True
        for i in range(at + 1, len(words)):
            if words[i] in ("and", "or", "with"):
                joined = True
            elif joined:
                joined = False
                if words[i] in SPDX:
                    yield i, SPDX[words[i]]
            else:
                break


def differences(part: list[str], template: list[str]) -> str:
    """The words that differ: ``-`` the template's, ``+`` the text's."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, template, part, autojunk=False).get_opcodes():
        if kind != "equal":
            out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in part[c:d]]
    return " ".join(out)


def confirmed(words: list[str], block: np.ndarray, template: Template) -> Iterator[tuple[int, int, int, bool]]:
    """Parts of a block with the template's wording and names, the best first: start, end, differing words, and whether the versions are its own."""
    differing, start = ends(block, template.words)
    parts = sorted((int(differing[e]), int(start[e]), e) for e in np.flatnonzero(differing <= template.most).tolist())
    for n, at, end in parts:
        names, versions = template.agrees(words[at:end])
        if names and end > at:
            yield at, end, n, versions


def matches(words: list[str]) -> list[tuple[int, int, str, float, int, str]]:
    """Findings in a block, none sharing a word: (start, end, license, reduction, differing words, the differences)."""
    have, block = set(words), np.array([CODES.get(w, -1) for w in words])
    text = " ".join(words)
    possible = [t for t in ALL if sum(n for w, n in t.counts.items() if w not in have) <= t.most]  # others can't be confirmed
    ranked = sorted(possible, key=lambda t: (-saved(text, t.text), t.license, t.text))
    taken, out = bytearray(len(words)), []

    def take(at: int, end: int, license: str, template: str, n: int) -> None:
        if not any(taken[at:end]):
            taken[at:end] = b"\1" * (end - at)
            part = words[at:end]
            out.append((at, end, license, reduction(" ".join(part), template), n, differences(part, template.split())))

    for at, name in tagged(words):
        taken[at:at + 1] = b"\1"
        out.append((at, at + 1, name, reduction(f"{TAG} {words[at]}", f"{TAG} {name.lower()}"), 0, ""))
    # In the order of the ranks; parts whose versions are not the template's own come after all that are.
    found = [(t, part) for t in ranked for part in confirmed(words, block, t)]
    for t, (at, end, n, versions) in sorted(found, key=lambda f: not f[1][3]):
        take(at, end, t.license if versions else f"{t.license.rsplit('-', 1)[0]} (version unresolved)", t.text, n)
    return sorted(out)


def place(text: str, at: int) -> tuple[int, int]:
    """Line and word of the line at a character."""
    before = text[text.rfind("\n", 0, at) + 1:at]
    return text.count("\n", 0, at), len(re.findall(WORD, before)) - bool(re.search(f"{WORD}$", before))


def clauses(found: list[tuple]) -> list[tuple]:
    """The opening and the second clause are shared by two licenses: of two clauses where the second stands in the text and the third
    does not, else of three."""
    labels = {f[2] for f in found}
    label = "BSD-2-Clause" if "BSD clause" in labels and "BSD-3-Clause" not in labels else "BSD-3-Clause"
    return [(*f[:2], label if f[2] in ("BSD", "BSD clause") else f[2], *f[3:]) for f in found]


def blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words within reach of a cue."""
    begin = end = None
    for i, w in enumerate(words):
        reach = REACH.get(w)
        if reach:
            if end is not None and i - reach > end:
                yield begin, end
                begin = None
            begin = max(0, i - reach) if begin is None else min(begin, max(0, i - reach))
            end = max(end or 0, i + reach + 1)
    if begin is not None:
        yield begin, min(end, len(words))


@functools.lru_cache(1)
def finder() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in REACH:
        found.add_word(w, w)
    found.make_automaton()
    return found


def scan(text: str | None) -> list[tuple[int, int, str, float, int, str]]:
    """Findings of a text: (line, word of the line, license, reduction, differing words, the differences)."""
    if not text or next(finder().iter(text.lower()), None) is None:
        return []
    tokens = [(m.start(), m[0].lower()) for m in TOKEN.finditer(text)]
    words, out = [w for _, w in tokens], []
    for begin, end in blocks(words):
        out += [(begin + at, *rest) for at, *rest in matches(words[begin:end])]
    return [(*place(text, tokens[at][0]), *rest) for at, _, *rest in clauses(out)]


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per license notice: ``doc_id, line_no, word_no, license, reduction, differing, differences``; line and word where it begins."""
    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(i, *f) for i, text in enumerate(part.column("text")) for f in scan(text.as_py())]
            if found:
                at, *columns = zip(*found)
                types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at)), *map(pa.array, columns, types)],
                    ["doc_id", "line_no", "word_no", "license", "reduction", "differing", "differences"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(
        find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line_no int, word_no int, license string, reduction double, differing long, "
        "differences string").select("doc_id", "line_no", "word_no", "license", F.round("reduction", 6).alias("reduction"), "differing", "differences")
