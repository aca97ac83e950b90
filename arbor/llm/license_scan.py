"""License scans by conditional compression.

A block of words that may be a notice is compressed alone and with each template as a zstandard raw dictionary. The share of
bytes that a template saves ranks the templates. Those that save any are aligned with the block word by word, and a place is
confirmed if the wording differs little enough; of templates that meet in a place, the one that saves most has it. The
differing words are part of the result. Blocks are the words about any whole part of a template: each is split so that one
part at least stands whole in any text that differs little enough, so no notice lies outside the blocks.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import unused, words

# Short public notices as their licences ask to put them, and opening passages of licence texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "Released under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words missing, added or changed, as a share of the template's, up to which a template is confirmed.
MOST_DIFFERENT = 0.1

_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_CLOSING = re.compile(r"[.,;:!?\"')\]]*")


class Scanner:
    """Compressors for the templates, made once for a task."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard as z

        flags = {"level": 12, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.words = {name: words(text) for name, text in templates.items()}
        self.alone = z.ZstdCompressor(**flags)
        self.given = {
            name: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(b" ".join(own), dict_type=z.DICT_TYPE_RAWCONTENT), **flags)
            for name, own in self.words.items()
        }
        self.most = {name: int(MOST_DIFFERENT * len(own) + 1e-9) for name, own in self.words.items()}
        # One part more than words may differ, under its first word: (part, template, where in it).
        self.parts: dict[bytes, list[tuple[list[bytes], str, int]]] = {}
        for name, own in self.words.items():
            edges = [len(own) * k // (self.most[name] + 1) for k in range(self.most[name] + 2)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    self.parts.setdefault(own[a], []).append((own[a:b], name, a))

    def ranked(self, block: list[bytes], names: Iterable[str] | None = None) -> list[tuple[float, str]]:
        """(share of the block's bytes saved, template) for each template, the largest first. Blocks are words, so case,
        punctuation and line breaks save nothing."""
        data = b" ".join(block)
        alone = len(self.alone.compress(data))
        return sorted(((1 - len(self.given[name].compress(data)) / alone, name) for name in names or self.given), key=lambda x: (-x[0], x[1]))

    def differences(self, theirs: list[bytes], name: str) -> tuple[list[str], list[str], int, int]:
        """The template's words that the words lack, the words inside the aligned part that it lacks, and that part."""
        own = self.words[name]
        matched = [m for m in difflib.SequenceMatcher(None, theirs, own, autojunk=False).get_matching_blocks() if m.size]
        if not matched:
            return [w.decode("utf-8", "replace") for w in own], [], 0, 0
        lo, hi = matched[0].a, matched[-1].a + matched[-1].size
        kept_theirs = {k for m in matched for k in range(m.a, m.a + m.size)}
        kept_own = {k for m in matched for k in range(m.b, m.b + m.size)}
        missing = [own[k].decode("utf-8", "replace") for k in range(len(own)) if k not in kept_own]
        added = [theirs[k].decode("utf-8", "replace") for k in range(lo, hi) if k not in kept_theirs]
        return missing, added, lo, hi

    def blocks(self, ws: list[bytes]) -> list[tuple[int, int]]:
        """(first word, end) of each block of the words: where a template would stand whose whole part is found, with the
        words that may have been added about it, and without; each once."""
        parts, found = self.parts, set()
        for i, w in enumerate(ws):
            for part, name, at in parts.get(w, ()):
                if ws[i : i + len(part)] == part:
                    size, most, begin = len(self.words[name]), self.most[name], i - at
                    found |= {(max(0, a), min(len(ws), b)) for a, b in ((begin - most, begin + size + most), (begin, begin + size))}
        return sorted(found)

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of candidate blocks of a text and the confirmed notices, by place."""
        ws = words(text)
        blocks = self.blocks(ws)
        places = [m.span() for m in _WORD.finditer(text)] if blocks else []
        found: dict[tuple[str, int, int], tuple[list[str], list[str]]] = {}
        for a, b in blocks:
            for reduction, name in self.ranked(ws[a:b]):
                if reduction <= 0:
                    break
                missing, added, lo, hi = self.differences(ws[a:b], name)
                if len(missing) + len(added) <= self.most[name]:
                    found[name, a + lo, a + hi] = missing, added
        hits = [(self.ranked(ws[lo:hi], [name])[0][0], name, lo, hi, *words_off) for (name, lo, hi), words_off in found.items()]
        # A place counts once for a template, as the closest match, of these the widest.
        hits.sort(key=lambda f: (len(f[4]) + len(f[5]), f[2] - f[3], -f[0], f[2]))
        once: list[tuple] = []
        for f in hits:
            if not any(g[1] == f[1] and g[2] < f[3] and f[2] < g[3] for g in once):
                once.append(f)
        # One that differs gives way to one of another template that saves as much or more and takes up half of it: GPL is
        # all but LGPL.
        once.sort(key=lambda f: (-f[0], len(f[4]) + len(f[5]), -len(self.words[f[1]]), f[2]))
        kept: list[dict] = []
        for reduction, name, lo, hi, missing, added in once:
            start, end = places[lo][0], _CLOSING.match(text, places[hi - 1][1]).end()
            exact = not missing and not added
            if exact or not any(2 * (min(g["end"], end) - max(g["start"], start)) >= end - start for g in kept):
                kept.append({"license": name, "start": start, "end": end, "reduction": reduction, "exact": exact, "missing": missing, "added": added})
        return len(blocks), sorted(kept, key=lambda f: (f["start"], f["end"], f["license"]))


def scanned(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``documents`` with n_blocks, licenses (sorted names, each once) and notices, in place of columns of those names.

    A notice has license, start, end (code points of its place), reduction (the share of bytes that the template saves of the
    place's words), exact, missing and added; n_blocks counts the blocks that are compressed. Null and empty texts have none, repeated rows are scanned each for itself, texts of any length
    whole, an empty table gives no rows, and other columns stay, whatever they are called. Nothing is shuffled; a task holds
    one batch of texts.
    """
    schema = "n_blocks int, notices array<struct<license: string, start: int, end: int, reduction: double, exact: boolean, missing: array<string>, added: array<string>>>"

    @F.pandas_udf(schema)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in texts:
            yield pd.DataFrame([scanner.scan(t) for t in batch], columns=["n_blocks", "notices"])

    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("n_blocks", "licenses", "notices")]
    made = unused(documents, "made")
    found = documents.select(*kept, scan("text").alias(made))
    notices = F.col(made)["notices"]
    return found.select(*kept, F.col(made)["n_blocks"].alias("n_blocks"), F.array_sort(F.array_distinct(notices["license"])).alias("licenses"), notices.alias("notices"))
