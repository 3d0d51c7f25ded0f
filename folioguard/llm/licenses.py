"""License scans by template markup.

A template is wording with ``<<beginOptional>> ... <<endOptional>>`` regions that
may be absent and ``<<var;name=...;words=a..b>>`` regions that any ``a`` to ``b``
words may replace.  Templates compile to automata over words; a text holds the
license if some stretch of its words leads from start to end, so all mandatory
wording has to stand there exactly.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The wording of license notices and texts, with markup.
TEMPLATES = {
    "gpl-notice": """<<beginOptional>>this work is<<endOptional>> <<beginOptional>>licensed under<<endOptional>>
        the gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>>
        version <<var;name=version;words=1..2>>""",
    "apache-2.0-notice": """licensed under the apache license version 2 0
        <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>""",
    "cc-notice": """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>>
        cc by <<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>>
        <<var;name=version;words=1..1>> 0""",
    "mit-notice": """<<var;name=verb;words=1..1>> under the mit license""",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>>
        shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var;name=holder;words=1..12>> be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software""",
    "isc-text": """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted provided that the above copyright notice and this permission
        notice appear in all copies the software is provided as is and <<var;name=holder;words=1..12>> disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met <<var;name=bullet;words=0..1>> redistributions of source code must retain
        the above copyright notice this list of conditions and the following disclaimer
        <<var;name=bullet;words=0..1>> redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution <<beginOptional>><<var;name=bullet;words=0..1>> neither the name of
        <<var;name=holder;words=1..20>> may be used to endorse or promote products derived from this software without
        specific prior written permission<<endOptional>>""",
}

_MARK = re.compile(r"<<(.*?)>>|([^<\s]+)", re.S)
_OUTSIDE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = re.compile(rb" +")


class Automaton:
    """A template as states with word edges, any-word edges and empty edges."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.empty: list[list[int]] = [[]]
        state, open_, runs, run, depth = 0, [], [], [], 0

        def new() -> int:
            self.words.append({})
            self.any.append(None)
            self.empty.append([])
            return len(self.words) - 1

        for mark, word in _MARK.findall(template):
            if word:
                nxt = new()
                self.words[state][word.lower().encode()] = nxt
                state = nxt
                run = [*run, word.lower().encode()] if not depth else run
                continue
            if not depth:
                runs, run = [*runs, run], []
            name = mark.split(";")[0]
            if name == "beginOptional":
                open_.append(state)
                depth += 1
            elif name == "endOptional":
                nxt = new()
                self.empty[state].append(nxt)
                self.empty[open_.pop()].append(nxt)
                state = nxt
                depth -= 1
            else:
                low, high = map(int, re.search(r"words=(\d+)\.\.(\d+)", mark).groups())
                steps = [state]
                for _ in range(high):
                    nxt = new()
                    self.any[steps[-1]] = nxt
                    steps.append(nxt)
                end = new()
                for s in steps[low:]:
                    self.empty[s].append(end)
                state = end
        if open_:
            raise ValueError("an optional region is not closed")
        self.end = state
        #: The longest mandatory wording: no match without it.
        self.anchor = b" " + b" ".join(max([*runs, run], key=lambda r: len(b" ".join(r)))) + b" "
        self.closure = [self._close(s) for s in range(len(self.words))]

    def _close(self, state: int) -> list[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return sorted(seen)

    def matches(self, words: Iterator[bytes]) -> list[tuple[int, int]]:
        """(first word, word after the last) of the longest match of each start,
        leftmost first, without overlaps."""
        live: dict[int, int] = {}
        best: dict[int, int] = {}
        for at, word in enumerate(words):
            for s in self.closure[0]:
                live.setdefault(s, at)
            ahead: dict[int, int] = {}
            for s, start in live.items():
                for t in (self.words[s].get(word), self.any[s]):
                    if t is not None:
                        for u in self.closure[t]:
                            ahead[u] = min(start, ahead.get(u, start))
            live = ahead
            if self.end in live:
                best[live[self.end]] = at + 1
        out: list[tuple[int, int]] = []
        for start in sorted(best):
            if not out or start >= out[-1][1]:
                out.append((start, best[start]))
        return out


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(text)) for label, text in templates]


def _joined(text: str | None) -> bytes:
    """The words of a text, each with a space before and after it."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_OUTSIDE)
    return _SPACES.sub(b" ", b" " + raw + b" ")


def _each_word(joined: bytes) -> Iterator[bytes]:
    return (m.group() for m in re.finditer(rb"[^ ]+", joined))


def scan_text(text: str | None, templates: Mapping[str, str] = TEMPLATES) -> dict:
    """Words, phrase places and template matches of one text; see ``scan``."""
    joined = _joined(text)
    places, base, found = [], set(), []
    for phrase, label in PHRASES.items():
        want = f" {phrase} ".encode()
        at, seen, words = joined.find(want), 0, 0
        while at >= 0:
            words += joined.count(b" ", seen, at)
            seen = at
            places.append(words)
            base.add(label)
            at = joined.find(want, at + 1)
    for label, automaton in compiled(tuple(templates.items())):
        if automaton.anchor in joined:
            found += [{"label": label, "first": a, "stop": b} for a, b in automaton.matches(_each_word(joined))]
    return {
        "n_words": joined.count(b" ") - 1,
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": sorted(base),
        "matches": found,
        "score": 1.0 if found else 0.5 if base else 0.0,
    }


KIND = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))), ("score", pa.float64()),
    ]
)


def scan(text: Column, templates: Mapping[str, str] = TEMPLATES) -> Column:
    """A struct for each whole text, in words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
    after A-Z is lower-cased:

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of
    the places where a phrase stands (nulls and an empty array if none does);
    ``matches``, an array of (label, first word, word after the last) of the
    templates; ``score``: 1 with a template match, 0.5 with phrases alone, 0
    else.  A null text counts as empty: no words, no matches.
    """
    rules = dict(templates)

    @F.arrow_udf("struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: array<string>, matches: array<struct<label: string, first: long, stop: long>>, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(t.as_py(), rules) for t in texts], KIND)

    return run(text)
