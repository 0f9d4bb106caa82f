"""Licence scan: matching statistics of documents against a generalised suffix automaton of licence templates.

The templates' words build one automaton on the driver (its size is that of the templates). Tasks stream the
words of each document through it. Words outside the templates end every match, so only runs of template
words are walked. At each word the automaton gives the longest piece of any template that ends there; long
maximal pieces chain, in order and with small gaps, into the spans of templates that they cover. A gap must not
hold a word that tells licences apart (versions, "lesser", "noncommercial" and the like), and a chain must cover
all such words of its template, so a text isn't given the licence that it excludes.

Null and empty texts have no words, places, labels, and a score of 0. Repeated rows are scanned each; columns
other than id and text are left out. Of an empty table nothing is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import ALNUM, Words

#: Phrases that give a label wherever their words stand consecutively. Fixed values.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Sentences of common licences; a star marks the words that tell a licence from its variants. Fixed values.
TEMPLATES = {
    "mit": [
        "released under the *mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "apache-2": [
        "licensed under the *apache license version *2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl-2": [
        "this work is licensed under the gnu *general public license version *2",
        "it under the terms of the gnu *general public license as published by the free software foundation either version *2 of the license or at your option any later version",
    ],
    "gpl-3": [
        "this work is licensed under the gnu *general public license version *3",
        "it under the terms of the gnu *general public license as published by the free software foundation either version *3 of the license or at your option any later version",
    ],
    "lgpl-2.1": [
        "this work is licensed under the gnu *lesser *general public license version *2 *1",
        "it under the terms of the gnu *lesser *general public license as published by the free software foundation either version *2 *1 of the license or at your option any later version",
    ],
    "lgpl-3": [
        "this work is licensed under the gnu *lesser *general public license version *3",
        "it under the terms of the gnu *lesser *general public license as published by the free software foundation either version *3 of the license or at your option any later version",
    ],
    "agpl-3": [
        "this work is licensed under the gnu *affero *general public license version *3",
        "it under the terms of the gnu *affero *general public license as published by the free software foundation either version *3 of the license or at your option any later version",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version *1 *1"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v *2 0"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license *2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by": ["this work is licensed under a creative commons *attribution *4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons *attribution *sharealike *4 0 international license"],
    "cc-by-nd": ["this work is licensed under a creative commons *attribution *noderivatives *4 0 international license"],
    "cc-by-nc": ["licensed under cc by *nc *4 0", "this work is licensed under a creative commons *attribution *noncommercial *4 0 international license"],
    "cc-by-nc-sa": ["licensed under cc by *nc *sa *4 0", "this work is licensed under a creative commons *attribution *noncommercial *sharealike *4 0 international license"],
    "cc-by-nc-nd": ["licensed under cc by *nc *nd *4 0", "this work is licensed under a creative commons *attribution *noncommercial *noderivatives *4 0 international license"],
}

#: Whole texts of short licences, beside their sentences: a text of which only parts are kept is still covered. Fixed values.
WHOLE = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including
        without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
        any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be
        liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *provided that the above copyright notice and this permission notice appear in
        all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
        author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
        the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but
        not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and
        on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
        damage""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to
        anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be
        misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution""",
    "bsl-1": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce
        display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
        the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole
        or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a
        compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt
        act of relinquishment in perpetuity of all present and future rights to this software under copyright law""",
    "wtfpl": """everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public
        license terms and conditions for copying distribution and modification you just do what the fuck you want to""",
}

TEMPLATES = {label: [*TEMPLATES.get(label, []), *([WHOLE[label]] if label in WHOLE else [])] for label in {**TEMPLATES, **WHOLE}}

#: Further words that no gap of a chain may hold. Fixed values.
TELLING = "not no except library lgpl agpl gpl fdl documentation dual proprietary noderivs nd sa nc sharealike share alike derivatives non commercial 0 1 2 3 4 5".split()

#: Fewest words of a piece that counts, most words of a gap in a chain, least share of a template that a chain covers.
MIN_PIECE, MAX_GAP, MIN_COVER = 4, 4, 0.6


@dataclass
class Automaton:
    """Suffix automaton of several sequences of word numbers. `where` has (template, end) of one occurrence for each template below a state."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    where: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.where.append({})
        return len(self.size) - 1

    def _extend(self, last: int, c: int) -> int:
        known = self.step[last].get(c)
        if known is not None and self.size[known] == self.size[last] + 1:
            return known
        new = None if known is not None else self._state(self.size[last] + 1, {}, 0)
        p = last
        while new is not None and p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.step[p][c]
        if self.size[q] == self.size[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        if new is None:
            return copy
        self.link[new] = copy
        return new

    def add(self, sequences: list[list[int]]) -> None:
        ends = []
        for t, sequence in enumerate(sequences):
            last = 0
            for k, c in enumerate(sequence):
                last = self._extend(last, c)
                ends.append((last, t, k + 1))
        for state, t, k in ends:
            self.where[state].setdefault(t, k)
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            for t, k in self.where[state].items():
                self.where[self.link[state]].setdefault(t, k)

    def walk(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: at each word the state and the length of the longest piece that ends there."""
        state, size = 0, 0
        for c in sequence:
            while state and c not in self.step[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.step[state]:
                state, size = self.step[state][c], size + 1
            yield state, size


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        marked = [(label, text.split()) for label, text in base.items()] + [(label, text.split()) for label, texts in templates.items() for text in texts]
        self.n_base = len(base)
        #: of each template, a bit for each of its words that must be covered
        self.needed = [sum(1 << i for i, w in enumerate(words) if w[0] == "*") for _, words in marked]
        telling = {*TELLING, *(w[1:] for _, words in marked for w in words if w[0] == "*")}
        named = [(label, [w.lstrip("*") for w in words]) for label, words in marked]
        self.labels = [label for label, _ in named]
        self.sizes = [len(words) for _, words in named]
        vocabulary = sorted({w for _, words in named for w in words} | telling)
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = common.word_hashes(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.automaton = Automaton()
        sequences = [[number[w] for w in words] for _, words in named]
        self.telling = np.array([w in telling for w in vocabulary])
        self.automaton.add(sequences)
        #: phrases whose words are the last ones of every match in a state: those at it or at the states that its links lead to
        at_end: dict[int, list[int]] = {}
        for t in range(self.n_base):
            state = 0
            for c in sequences[t]:
                state = self.automaton.step[state][c]
            at_end.setdefault(state, []).append(t)
        self.endings: list[list[int]] = [[] for _ in self.automaton.size]
        for state in sorted(range(1, len(self.endings)), key=lambda s: self.automaton.size[s]):
            self.endings[state] = at_end.get(state, []) + self.endings[self.automaton.link[state]]
        self.shortest = min([MIN_PIECE, *self.sizes[: self.n_base]])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def scan(self, words: Words, n_docs: int) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int, int, int]]], list[np.ndarray]]:
        """Of each document: (start, phrase) of the base places, the pieces (template, start, end, end in the template), and how many telling words stand before each word (of those with pieces)."""
        places: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
        pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n_docs)]
        before_each = [np.zeros(1, np.int64)] * n_docs
        if not len(words):
            return places, pieces, before_each
        numbers = self.numbers(words.hash)
        heads = np.flatnonzero(np.concatenate([[True], (words.doc[1:] != words.doc[:-1]) | ((numbers[1:] < 0) != (numbers[:-1] < 0))]))
        tails = np.append(heads[1:], len(numbers))
        runs = (numbers[heads] >= 0) & (tails - heads >= self.shortest)
        automaton = self.automaton
        for head, tail in zip(heads[runs].tolist(), tails[runs].tolist(), strict=True):
            doc = int(words.doc[head])
            base = int(words.first[doc])
            before = (0, 0)
            for i, (state, size) in enumerate([*automaton.walk(numbers[head:tail].tolist()), (0, 0)], head - base):
                for t in self.endings[state]:
                    if size >= self.sizes[t]:
                        places[doc].append((i - self.sizes[t] + 1, t))
                if before[1] >= MIN_PIECE and size <= before[1]:  # it cannot be made longer
                    pieces[doc] += [(t, i - before[1], i, k) for t, k in automaton.where[before[0]].items() if t >= self.n_base]
                before = (state, size)
        told = np.concatenate([[0], np.cumsum((numbers >= 0) & self.telling[np.maximum(numbers, 0)])])
        for doc, own in enumerate(pieces):
            if own:
                before_each[doc] = told[words.first[doc] : words.first[doc + 1] + 1]
        return places, pieces, before_each

    def chains(self, pieces: list[tuple[int, int, int, int]], told: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template covered) of the best chain of each template."""
        out = []
        for t in sorted({p[0] for p in pieces}):
            needed = self.needed[t]
            #: (start, end, end in the template, covered words as bits, first word of the chain) of the best chain that ends with each piece
            ended: list[tuple[int, int, int, int, int]] = []
            best: tuple[bool, int, int, int] = (False, 0, 0, 0)
            for _, a, b, k in sorted((p for p in pieces if p[0] == t), key=lambda p: (p[2], p[1])):
                own = (1 << k) - (1 << (k - b + a))
                chain = (own, a)
                for a0, b0, k0, covered, first in reversed(ended):
                    if a - b0 > MAX_GAP:
                        break
                    fits = a0 < a and k0 < k and (a < b0 or told[a] == told[b0])
                    chain = max(chain, (covered | own, first), key=lambda c: c[0].bit_count()) if fits else chain
                ended.append((a, b, k, *chain))
                best = max(best, (chain[0] & needed == needed, chain[0].bit_count(), -chain[1], b))
            if best[0] and best[1] >= MIN_COVER * self.sizes[t]:
                out.append((self.labels[t], -best[2], best[3], best[1] / self.sizes[t]))
        return out


_SCHEMA = "n_words long, places array<struct<label:string,first_word:long>>, chains array<struct<label:string,first_word:long,end_word:long,cover:double>>"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
_CHAIN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, n_words, places of the base phrases, chains over the templates) of each document; whole texts, no shuffle."""
    scanner = Scanner(base, templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a), ALNUM)
                places, pieces, told = scanner.scan(words, b - a)
                found = [[{"label": scanner.labels[t], "first_word": i} for i, t in own] for own in places]
                chains = [[dict(zip(("label", "first_word", "end_word", "cover"), c, strict=True)) for c in scanner.chains(own, before)] for own, before in zip(pieces, told, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(words.first)), pa.array(found, _PLACE), pa.array(chains, _CHAIN)], [id_col, "n_words", "places", "chains"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, common.text_of(text_col).alias("text")).mapInArrow(scan, f"{id_col} {kind}, {_SCHEMA}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "chains.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("chains.cover"), F.lit(0.0))).alias("score"),
    )
