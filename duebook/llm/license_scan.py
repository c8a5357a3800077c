"""License scans by fuzzy search for short notices.

A text is lower-cased in A-Z and reduced to its words with one space between. A notice may differ by up to ``allowed`` characters put in, left
out or changed. Cut into one piece more than that, it has at least one piece without any edit (pigeonhole), so all pieces of all notices are
sought at once by one automaton; where a piece stands, the notice can only lie within a few characters of its place, and there the regex
library's bounded-error matching, best match first, tells whether it does, with how many edits. A match starts and ends with whole words,
and short words that tell one license from another (``mit``, ``bsd``, ``cc``) must stand in it as they are. Its span is given in code points of the source.

Base detectors besides: places where the words of a known phrase stand one after the other. They always count, whatever the search finds.

Null or empty text: no words and no labels. Texts are read whole, some at a time, of any length; time is linear in a text plus what lies
around seeds. Ties: of overlapping matches of one notice the best stays, the first of equals; unlike notices may overlap. Repeated rows give
equal rows, other columns change nothing, an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import map_rows, release

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: One edit is allowed for so many characters of a notice.
CHARACTERS_AN_EDIT = 10

# Phrases of the base detectors, and notices, each with its label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license version 2 0", "apache"),
    ("licensed under the apache license", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons zero", "cc0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc0 1 0 universal", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("spdx license identifier", "spdx"),
)
#: Words that must stand in a match of a notice that holds them.
EXACT = frozenset("gnu gpl mit bsd isc cc by sa nc nd cc0 mozilla eclipse boost lesser affero apache".split())
#: Notices of so few characters are taken as they are.
SHORTEST = 10

_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


class Match(NamedTuple):
    label: str
    start: int  # of the reduced text, as is ``end``
    end: int
    edits: int
    size: int  # of the notice


def allowed(notice: str) -> int:
    return len(notice) // CHARACTERS_AN_EDIT if len(notice) > SHORTEST else 0


def pieces(notice: str) -> list[tuple[int, str]]:
    """(place, piece): the notice cut into one piece more than edits are allowed, of like sizes."""
    n = allowed(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Search:
    """The automaton of all pieces and a pattern per notice."""

    def __init__(self, notices: tuple[tuple[str, str], ...]):
        import ahocorasick
        import regex

        seeds: dict[str, list[tuple[int, int]]] = {}
        self.notices, self.patterns, self.exact = notices, [], []
        for k, (notice, _) in enumerate(notices):
            for at, piece in pieces(notice):
                seeds.setdefault(piece, []).append((k, at))
            self.patterns.append(regex.compile(rf"(?b)(?<=\ )(?:{regex.escape(notice, literal_spaces=True)}){{e<={allowed(notice)}}}(?=\ )"))
            self.exact.append(EXACT & set(notice.split()))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per notice, the stretches of the text, apart and in order, outside which it cannot stand."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                notice = self.notices[k][0]
                slack = allowed(notice) + 1
                low = last + 1 - size - at - slack
                high = low + len(notice) + 2 * slack
                held = found.setdefault(k, [])
                while held and held[-1][0] >= low:  # a later piece of the notice can start a stretch further left
                    high = max(high, held.pop()[1])
                if held and held[-1][1] >= low:
                    held[-1][1] = max(held[-1][1], high)
                else:
                    held.append([low, high])
        return found

    def _within(self, k: int, text: str, low: int, high: int) -> set[tuple[int, int, int]]:
        """(edits, start, end) of the best match in a stretch and of those on either side of it."""
        found, todo = set(), [(max(low, 0), min(high, len(text)))]
        while todo:
            low, high = todo.pop()
            if low < high and (m := self.patterns[k].search(text, low, high)):
                good = self.exact[k] <= set(m[0].split())
                if good:
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
                todo += [(low, m.start()), (m.end() if good else m.start() + 1, high)]
        return found

    def matches(self, text: str) -> list[Match]:
        out = []
        for k, held in self.windows(text).items():
            notice, label = self.notices[k]
            size, found = len(notice), set()
            for low, high in held:
                # a long stretch is read in parts that hold every match whole, so its time is linear
                for at in range(low, high, 2 * size):
                    found |= self._within(k, text, at, min(high, at + 4 * size))
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(found):
                i = bisect_left(taken, (start, end))
                if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                    taken.insert(i, (start, end))
                    out.append(Match(label, start, end, edits, size))
        return sorted(out, key=lambda m: (m.start, m.label, m.end))


@cache
def _search(notices: tuple[tuple[str, str], ...]) -> _Search:
    return _Search(notices)


def reduced(text: str) -> tuple[bytes, int]:
    """The words with a space before and after each, in UTF-8, and their number."""
    words = text.encode("utf-8", "replace").translate(_PLAIN).split(b" ")
    words = [w for w in words if w]
    return b" ".join([b"", *words, b""]), len(words)


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands in a reduced text."""
    found = []
    for phrase, label in PHRASES:
        key = f" {phrase} ".encode()
        at = text.find(key)
        while at >= 0:
            found.append((text.count(b" ", 0, at), label))
            at = text.find(key, at + 1)
    return found


def source_spans(text: str, plain: str, found: list[Match]) -> list[tuple[int, int]]:
    """The matches' places in the source, end exclusive, by counting words."""
    words = [(m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", "a", text))] if found else []
    return [(words[plain.count(" ", 0, m.start) - 1][0], words[plain.count(" ", 0, m.end) - 1][1]) for m in found]


def scan(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> tuple[int, list[tuple[int, str]], list[tuple[Match, tuple[int, int]]]]:
    """(words, base places, matches with their spans in the source) of a text."""
    text = text or ""
    raw, n = reduced(text)
    plain = raw.decode()
    found = _search(notices).matches(plain)
    return n, base_places(raw), list(zip(found, source_spans(text, plain, found), strict=True))


def score(base: list, found: list[tuple[Match, tuple[int, int]]]) -> float:
    """1 for a phrase or a notice without edits, less by the share of edits of the best match, 0 without any."""
    return 1.0 if base else max((1 - m.edits / m.size for m, _ in found), default=0.0)


def _scan(batch):
    release()
    out: list[list] = [[] for _ in range(8)]
    for text in batch.column("text").to_pylist():
        n, base, found = scan(text)
        at = [w for w, _ in base]
        row = (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
               ",".join(sorted({x for _, x in base} | {m.label for m, _ in found})), score(base, found),
               [{"label": m.label, "start": s, "end": e, "edits": m.edits} for m, (s, e) in found])
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


_ADDED = ("l__n_words long, l__n_base long, l__first_word long, l__last_word long, l__base_labels string, l__labels string, l__score double, "
          "l__matches array<struct<label: string, start: long, end: long, edits: long>>")


def licenses(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the counts and labels of each text, and its matches with their spans in code points and their edits."""
    keep = list(dict.fromkeys(keep))
    rows = map_rows(docs.select(*dict.fromkeys([*keep, "text"])), _scan, _ADDED, keep)
    return rows.select(*keep, *[F.col(c).alias(c[3:]) for c in rows.columns if c not in keep])


def op13(docs: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"])), ",")
    return licenses(docs, "doc_id").withColumn("spans", spans).drop("matches")
