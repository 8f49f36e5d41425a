"""Licence scan: matching statistics of texts against a generalised suffix automaton of licence tokens.

All templates and base phrases go into one automaton over word tokens. A text is streamed through it: after
each word the state and the length of the longest suffix that some template holds are known. A base phrase
ends at a word when its state is the current one or above it by suffix links. Matches that cannot be extended
and have at least ``MIN_MATCH`` words are chained per template, forwards in both text and template, into
spans; a span that covers at least ``MIN_COVER`` of its template gives the template's label.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower case. Where a template holds
a phrase more than once, its first place there counts. Null texts are empty: no words, no labels, score 0.
"""

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from barometry.llm.common import add_columns, as_bytes

MIN_MATCH = 3
MIN_COVER = 0.75
#: Words that may lie between two matches of a chain, in the text and in the template.
MAX_GAP = 12

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices and grants as the licences word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."),
}

# A-Z to a-z, word bytes as they are, all other bytes to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, int]] = [{}]  # template -> words up to the end of its first occurrence
        self.names = list(templates)
        sequences = [self.numbers(t) for t in templates.values()]
        sequences_of_phrases = [self.numbers(p) for p in phrases]
        self.sizes = [len(s) for s in sequences]
        for i, sequence in enumerate(sequences + sequences_of_phrases):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self.extend(last, word)
                if i < len(templates):
                    self.places[last].setdefault(i, end)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:
            above = self.places[self.link[state]]
            for template, end in self.places[state].items():
                above[template] = min(end, above.get(template, end))
        ending: list[list[tuple[int, str]]] = [[] for _ in self.length]
        for sequence, label in zip(sequences_of_phrases, phrases.values()):
            state = 0
            for word in sequence:
                state = self.moves[state][word]
            ending[state].append((len(sequence), label))
        # The phrases that end wherever a state is reached; a state holds a phrase only if all its words do.
        for state in reversed(order):
            own = ending[state] if ending[state] and self.length[self.link[state]] < ending[state][0][0] else []
            ending[state] = own + ending[self.link[state]]
        self.ending = ending

    def numbers(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in word_list(text.encode())]

    def state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.moves.append(moves)
        self.link.append(link)
        self.places.append({})
        return len(self.length) - 1

    def split(self, state: int, word: int) -> int:
        """The state for the words of ``state`` followed by ``word``, taken out of the target if that is longer."""
        target = self.moves[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self.state(self.length[state] + 1, dict(self.moves[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.moves[state].get(word) == target:
            self.moves[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.moves[last]:
            return self.split(last, word)
        new = self.state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.moves[state]:
            self.moves[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self.split(state, word)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, dict[int, int]]]]:
        """Base phrases (start, label), and matches that cannot be extended (start, words, places)."""
        phrases: list[tuple[int, str]] = []
        matches: list[tuple[int, int, dict[int, int]]] = []
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        inside = np.concatenate([[False], codes >= 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        # Outside these runs no template word stands: the state is the initial one there.
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= 2:
                self.scan_run(codes[a:b].tolist(), a, phrases, matches)
        return phrases, matches

    def scan_run(self, codes: list[int], begin: int, phrases: list, matches: list) -> None:
        moves, link, length, ending = self.moves, self.link, self.length, self.ending
        state = size = 0
        for i, code in enumerate(codes, begin):
            if code not in moves[state]:
                if size >= MIN_MATCH:
                    matches.append((i - size, size, self.places[state]))
                while state and code not in moves[state]:
                    state = link[state]
                    size = length[state]
            state = moves[state].get(code, 0)
            size = size + 1 if state else 0
            # A state stands for all suffixes with its end places: a phrase longer than the match is not there.
            for n, label in ending[state]:
                if n <= size:
                    phrases.append((i - n + 1, label))
        if size >= MIN_MATCH:
            matches.append((begin + len(codes) - size, size, self.places[state]))

    def chains(self, matches: list[tuple[int, int, dict[int, int]]]) -> list[tuple[int, int, int, float]]:
        """Spans (template, first word, end word, share of the template) from matches in text order."""
        found, open_chains = [], {}
        for start, size, places in matches:
            for template, end in places.items():
                at = end - size
                chain = open_chains.get(template)
                # Overlap with the match before is cut off, in the text or in the template.
                cut = max(0, chain[1] - start, chain[3] - at) if chain else 0
                if chain and cut < size and start - chain[1] <= MAX_GAP and at - chain[3] <= MAX_GAP and at >= chain[4]:
                    chain[1], chain[2], chain[3], chain[4] = start + size, chain[2] + size - cut, end, at
                else:
                    if chain:
                        found.append((template, *chain[:3]))
                    open_chains[template] = [start, start + size, size, end, at]
        found += [(template, *chain[:3]) for template, chain in open_chains.items()]
        return [(t, a, b, min(1.0, n / self.sizes[t])) for t, a, b, n in found]


def scan_text(automaton: Automaton, text: bytes) -> tuple:
    words = word_list(text)
    phrases, matches = automaton.scan(words)
    spans = automaton.chains(matches)
    base = sorted({label for _, label in phrases})
    good = sorted((a, b, automaton.names[t]) for t, a, b, share in spans if share >= MIN_COVER)
    starts = [a for a, _ in phrases]
    score = max([1.0 if phrases else 0.0, *(share for *_, share in spans)])
    return (len(words), len(phrases), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted({*base, *(name for *_, name in good)})), score, ",".join(f"{n}:{a}:{b}" for a, b, n in good))


OUTPUTS = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
           "base_labels": "string", "labels": "string", "score": "double", "spans": "string"}


def license_scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
                 phrases: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``OUTPUTS``; ``spans`` lists label:first word:end word."""
    automaton = Automaton(TEMPLATES if templates is None else templates, BASE_PHRASES if phrases is None else phrases)

    def make():
        def work(texts):
            rows = [scan_text(automaton, x or b"") for x in as_bytes(texts)]
            return [list(c) for c in zip(*rows)]

        return work

    return add_columns(df, [text], OUTPUTS, make, drop)
