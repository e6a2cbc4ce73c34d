"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

Tokens are pairs of consecutive words, so that order counts as well. A block is a window of pairs, whatever line breaks and
signs stand between the words, so wrapped and commented notices are whole. Its length is the template's over `threshold`,
so pairs scattered over a long line are no notice. A template, short or long, is found in it if the window holds at least
`threshold` of the template's distinct pairs, those among them that tell its label from others (DECISIVE).

A text can have such a window only if it holds so many of the pairs itself, which is joined first. Template pairs are
ordered by the number of texts in the whole corpus that hold them, rarest first (ties by the pair). A text that reaches
the threshold holds one of the first |T| - ceil(threshold*|T|) + 1 pairs (prefix filter), at least ceil(threshold*|T|)
distinct pairs (length filter), and from its first shared pair on enough of the template is left (positional filter).
What passes is counted exactly, and its windows are then slid over the template's pairs. The vocabulary is that of the
templates, so corpus counts and index are small whatever the corpus.

Defined results: null and empty texts have no words, no labels and score 0; an empty table gives none; further columns are left out; repeated rows and rows of equal or null
doc_id are texts of their own; lines and texts of any length are slid over in one pass, in memory of one text; windows that reach the threshold and
overlap are one block, with the line and the containment of the best of them, the first of equals.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of

#: label: phrase. Its words must stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def _gnu(name: str, version: str) -> tuple[str, ...]:
    terms = f"it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or"
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        f"""This program is free software: you can redistribute it and/or modify {terms} (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.""",
        f"{terms} any later version",
    )


#: label: notices, whole as licences ask for them, or one of their paragraphs, or the line that is common instead. A label
#: is found if any of its notices is. Fixed values.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""",
    ),
    "mit": (
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions:""",
        """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ),
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""",
    ),
    "gpl-2.0": _gnu("General Public License", "2"),
    "gpl-3.0": _gnu("General Public License", "3"),
    "lgpl-2.1": _gnu("Lesser General Public License", "2.1"),
    "lgpl-3.0": _gnu("Lesser General Public License", "3"),
    "agpl-3.0": _gnu("Affero General Public License", "3"),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}
#: label: identifiers of licence lists. Fixed values.
IDENTIFIERS = {
    "apache-2.0": ("Apache-2.0",), "mit": ("MIT",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "gpl-2.0": ("GPL-2.0",), "gpl-3.0": ("GPL-3.0",), "lgpl-2.1": ("LGPL-2.1",), "lgpl-3.0": ("LGPL-3.0",),
    "agpl-3.0": ("AGPL-3.0",), "mpl-2.0": ("MPL-2.0",), "isc": ("ISC",), "unlicense": ("Unlicense",), "cc-by-nc-4.0": ("CC-BY-NC-4.0",), "cc-by-sa-4.0": ("CC-BY-SA-4.0",),
}
TEMPLATES = {label: (*notices, *(f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS.get(label, ()))) for label, notices in TEMPLATES.items()}
#: label: pairs that each of its notices must show where it has them. Fixed values.
DECISIVE = {
    "apache-2.0": ("the apache", "2 0"), "gpl-2.0": ("gnu general", "version 2"), "gpl-3.0": ("gnu general", "version 3"), "lgpl-2.1": ("gnu lesser", "version 2", "2 1"),
    "lgpl-3.0": ("gnu lesser", "version 3"), "agpl-3.0": ("gnu affero", "version 3"), "mpl-2.0": ("mozilla public",), "cc-by-nc-4.0": ("by nc", "nc 4", "attribution noncommercial", "noncommercial 4"),
    "cc-by-sa-4.0": ("by sa", "attribution sharealike"),
}
#: Every byte that is no word byte becomes a space, A-Z become lower case: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pairs(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Pairs of consecutive words, by the place of the first."""
    return list(zip(words, words[1:], strict=False))


def _tokens(notice: str) -> list[tuple[bytes, ...]]:
    found = pairs(notice.encode().translate(_WORDS).split())
    if not found:
        raise ValueError(f"a notice has two words at least: {notice!r}")
    return found


def template_sets(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, frozenset[tuple[bytes, ...]]]]:
    return [(label, frozenset(_tokens(notice))) for label, notices in templates.items() for notice in notices]


def template_lengths(templates: dict[str, tuple[str, ...]]) -> list[int]:
    """Pairs of each notice, in the order of template_sets."""
    return [len(_tokens(notice)) for notices in templates.values() for notice in notices]


def pair_frequencies(docs: DataFrame, vocabulary: frozenset[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """Texts of the corpus that hold each pair of the vocabulary (bounded by the templates' size)."""
    schema = pa.schema([("pair", pa.binary()), ("n", pa.int64())])

    def step(batch):
        found: Counter = Counter()
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text:
                words = text.translate(_WORDS).split()
                found.update(vocabulary.intersection(zip(words, words[1:], strict=False)))
        yield batch_of(schema, [b" ".join(p) for p in found], list(found.values()))

    rows = arrow_map(docs.select("text"), step, "pair binary, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {tuple(bytes(r.pair).split()): r.n for r in rows}


def needs(templates: list[tuple[str, frozenset]], lengths: list[int], threshold: float) -> list[tuple[int, int, frozenset]]:
    """Of each template: distinct pairs that it needs, the length of its windows, and its decisive pairs."""
    out = []
    for (label, own), n in zip(templates, lengths, strict=True):
        decisive = own.intersection(tuple(p.encode().split()) for p in DECISIVE.get(label, ()))
        out.append((math.ceil(threshold * len(own) - 1e-9), math.ceil(n / threshold - 1e-9), decisive))
    return out


class Join:
    """The index of the templates and its probe, whatever the tokens are. lengths: tokens of each template, as many as are distinct by default."""

    def __init__(self, templates: list[tuple[str, frozenset]], frequencies: dict, threshold: float, lengths: list[int] | None = None):
        self.threshold, self.index, self.templates = threshold, {}, []
        asked = needs(templates, lengths or [len(words) for _, words in templates], threshold)
        self.windows = [width for _, width, _ in asked]
        for (label, words), (need, _, decisive) in zip(templates, asked, strict=True):
            ordered = sorted(words, key=lambda w: (frequencies.get(w, 0), w))
            at = len(self.templates)
            self.templates.append((label, words, len(ordered), need, decisive))
            for place, word in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(word, []).append((at, place))
        self.prefixes = frozenset(self.index)

    def reached(self, block: frozenset) -> dict[int, int]:
        """number of a template: shared tokens, of templates that reach the threshold."""
        first: dict[int, int] = {}
        for word in self.prefixes & block:
            for at, place in self.index[word]:
                first[at] = min(place, first.get(at, place))
        out: dict[int, int] = {}
        for at, place in first.items():
            _, words, size, need, decisive = self.templates[at]
            if len(block) >= need and size - place >= need and decisive <= block and (shared := len(words & block)) >= need:
                out[at] = shared
        return out

    def probe(self, block: frozenset) -> dict[str, float]:
        """label: containment, of templates that reach the threshold."""
        out: dict[str, float] = {}
        for at, shared in self.reached(block).items():
            label, _, size, _, _ = self.templates[at]
            out[label] = max(out.get(label, 0.0), shared / size)
        return out

    def blocks(self, words: list) -> list[tuple[int, str, float]]:
        """(first token, label, containment) of each block of a text's tokens, in this order."""
        out = []
        for at in self.reached(frozenset(words)):
            label, sought, size, need, decisive = self.templates[at]
            places = [k for k, word in enumerate(words) if word in sought]
            held: Counter = Counter()
            left, end, best = 0, -1, None
            for k in places:
                held[words[k]] += 1
                while places[left] <= k - self.windows[at]:
                    held[words[places[left]]] -= 1
                    if not held[words[places[left]]]:
                        del held[words[places[left]]]
                    left += 1
                if len(held) >= need and all(w in held for w in decisive):
                    if best and places[left] > end:
                        out.append(best)
                        best = None
                    if not best or len(held) / size > best[2]:
                        # Tokens in front that the window holds again don't belong to the notice.
                        start, more = left, held.copy()
                        while more[words[places[start]]] > 1:
                            more[words[places[start]]] -= 1
                            start += 1
                        best = (places[start], label, len(held) / size)
                    end = k
            if best:
                out.append(best)
        return sorted(out)


def _phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Starts, in words, of a phrase in words joined and surrounded by single spaces."""
    out, at = [], joined.find(phrase)
    count, upto = 0, 0
    while at >= 0:
        count += joined.count(b" ", upto, at)
        upto = at
        out.append(count)
        at = joined.find(phrase, at + 1)
    return out


def scan(docs: DataFrame, threshold: float = 0.8, phrases: dict[str, str] | None = None, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word long, base_labels, labels string, score double, blocks array<struct<line int, label string, containment double>>."""
    known = template_sets(TEMPLATES if templates is None else templates)
    lengths = template_lengths(TEMPLATES if templates is None else templates)
    join = Join(known, pair_frequencies(docs, frozenset().union(*(w for _, w in known))), threshold, lengths)
    sought = [(label, b" " + b" ".join(phrase.encode().translate(_WORDS).split()) + b" ") for label, phrase in (PHRASES if phrases is None else phrases).items()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    block = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))

    def step(batch):
        schema = pa.schema([("doc_id", batch.schema.field(0).type), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", block)])
        columns: list[list] = [[] for _ in range(8)]
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            words = text.translate(_WORDS).split()
            joined = b" " + b" ".join(words) + b" "
            places, base = [], set()
            for label, phrase in sought:
                if found := _phrase_places(joined, phrase):
                    places += found
                    base.add(label)
            blocks = []
            if not join.prefixes.isdisjoint(zip(words, words[1:], strict=False)):
                if found := join.blocks(pairs(words)):
                    ends = list(accumulate(len(line.translate(_WORDS).split()) for line in text.split(b"\n")))
                    blocks = [{"line": bisect_right(ends, k), "label": label, "containment": c} for k, label, c in found]
            score = max([1.0] * bool(base) + [b["containment"] for b in blocks], default=0.0)
            row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b["label"] for b in blocks})), score, blocks)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        yield batch_of(schema, batch.column(0), *columns)

    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:int,label:string,containment:double>>"
    return arrow_map(docs.select("doc_id", "text"), step, out)
