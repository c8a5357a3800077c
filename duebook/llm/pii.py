"""Personal data with offset-preserving deobfuscation.

Base detectors read the text as it is. Then transducers rewrite disguises - look-alike letters and digits, invisible characters,
spelled digits, bracketed or spelled at and dot - into a normalised text and record for every rewritten piece where it came from.
The same detectors read the normalised texts (digits left, spelled runs joined, spelled digits joined to any beside them, letters that
look like digits read as digits); what they find across a rewritten piece is mapped back to source characters and added. Base spans
always stay; a span within a base span of its kind is not added, and neither is one that digit words make wider: a number that is one
without the word beside it is whole.

Null or empty text: no spans. Spans count code points, end exclusive, in the whole text, and of spans with one start (ties) the kind
listed first comes first. Each pattern is entered only where a run starts, so texts of a megabyte cost linear time, also where they are
one word. Repeated rows give equal rows, other columns change nothing, an empty table gives no rows.

``_HINTS`` only saves time: a text that matches none of them is one that no transducer rewrites, since every edit starts from a character
of ``_rewritten_class`` or leaves a match of a hint in the text as it is (each hint is its transducer's pattern with parts left out).
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import map_rows, release, same_columns
from duebook.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")

# Words and look-alikes the transducers know.
DIGIT_WORDS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
PLUS_WORDS = ("plus", "más", "mas")
AT_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")
#: Endings that are common words as well: "at this point in" is no address.
WORDS_TOO = frozenset("am as be by do in is la me my no pm so to".split())
#: Characters that look like a letter, from the public table of confusable characters, by the letter; what NFKC folds is not listed.
_LIKE = {
    "a": "аɑα⍺ᴀ", "b": "Ьʙᖯ", "c": "сϲᴄⲥ", "d": "ԁᴅᏧᑯ", "e": "еҽᴇ℮", "f": "ꜰẝϝ", "g": "ɡցɢᶃ", "h": "һհᏂʜ", "i": "іıɩιɪӏꙇᎥ", "j": "јϳᴊ", "k": "кκᴋ", "l": "ʟⅼ",
    "m": "ᴍ", "n": "ոռɴ", "o": "оοօᴏσഠ൦", "p": "рρᴘϱ", "q": "ԛգզ", "r": "гᴦʀꭇ", "s": "ѕꜱƽ", "t": "тτᴛ", "u": "սυᴜʋ", "v": "νѵᴠ", "w": "ԝաѡɯᴡ", "x": "хχᕁ", "y": "уүγʏყ", "z": "ᴢ",
    "A": "АΑᎪᗅ", "B": "ВΒᏴᗷ", "C": "СϹᏟ", "D": "ᎠᗞᗪĐ", "E": "ЕΕᎬ", "F": "Ϝᖴ", "G": "ԌᏀ", "H": "НΗᎻᕼ", "I": "ІΙӀİⵏ", "J": "ЈᎫᒍ", "K": "КΚᏦ", "L": "Ꮮᒪ", "M": "МΜᎷᗰ",
    "N": "ΝⲚ", "O": "ОΟՕⲞ", "P": "РΡᏢᑭ", "Q": "Ԛⵕ", "R": "ᎡᏒᖇ", "S": "ЅՏᏕ", "T": "ТΤᎢ", "U": "Սᑌ", "V": "ѴᏙᐯ", "W": "ᎳᏔԜ", "X": "ХΧⵝ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "-": "‐‑‒–−", ".": "․。", " ": "\u00a0\u2007\u202f",
}
LOOKALIKES = {c: letter for letter, like in _LIKE.items() for c in like}
INVISIBLE = "­​‌‍⁠﻿"

_DIGIT = {w: str(d) for words in DIGIT_WORDS for d, w in enumerate(words)} | {w: "+" for w in PLUS_WORDS}
_ANY_DIGIT = "|".join(sorted(_DIGIT, key=len, reverse=True))
_SPELLED_DOT = rf"\x20(?:{'|'.join(DOT_WORDS)})\x20"
#: Between two items of a run: little white space and signs, or a dot. A dot with white space before a capital ends a sentence.
_SEPARATOR = rf"(?:[\x20,;/\t\n-]{{1,3}}|[\x20]?\.(?:[\x20\t\n](?!(?-i:[A-Z])))?|{_SPELLED_DOT})"
#: Four spelled digits in a row at least, mixed with plain ones.
_SPELLED = re.compile(rf"(?<!\w)(?:{_ANY_DIGIT})(?:{_SEPARATOR}(?:{_ANY_DIGIT}|[0-9]{{1,4}})(?!\w)){{3,}}", re.I)
#: One spelled digit or dot at least in a run with plain ones; whether it is an identifier is left to the detectors.
_ITEM = rf"(?:{_ANY_DIGIT}|[0-9]{{1,19}})(?!\w)"
_MIXED = re.compile(rf"(?<!\w){_ITEM}(?:{_SEPARATOR}{_ITEM})+", re.I)
_WORD_OR_DIGITS = re.compile(rf"(?:{_ANY_DIGIT}|[0-9]+)(?!\w)", re.I)
_HAS_DOT = re.compile(rf"\.|{_SPELLED_DOT}", re.I)


_at, _dot, _ENDINGS = "|".join(AT_WORDS), "|".join(DOT_WORDS), frozenset(ENDINGS)
_OPEN, _CLOSE = r"[\x20]?[\[({<][\x20]?", r"[\x20]?[\])}>][\x20]?"
#: Bracketed at: a sign of its own. A spelled at needs a known ending after it, and a spelled dot, or a plain one if what stands before it looks
#: like a mailbox (``_mailbox``). A plain dot before a capital and one small letter ends a sentence ("at noon.It was").
_BRACKET_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:{_at}|@){_CLOSE})(?=[A-Za-z0-9])", re.I)
_BRACKET_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:{_dot}|\.){_CLOSE})(?=[A-Za-z0-9])", re.I)
_AT = re.compile(rf"\x20(?:{_at})\x20|\x20?@\x20?", re.I)
_LABEL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"
_BEHIND = re.compile(rf"\x20(?:{_dot})\x20\Z", re.I)
_BEHIND_ANY = re.compile(rf"\x20(?:{_dot})\x20", re.I)
_SITE = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|\x20(?:{_dot})\x20)[A-Za-z0-9-]++)*+", re.I)
#: Between two labels: a spelled dot, or a plain one.
_STEP = re.compile(rf"\x20({_dot})\x20|\.", re.I)
_SENTENCE = re.compile(r"[A-Z][a-z](?![A-Za-z0-9])")
#: An address in one word: "anna-at-site-dot-com".
_IN_ONE = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+]+)([-_])(?:{_at})\2([A-Za-z0-9]+(?:\2(?:{_dot})\2[A-Za-z0-9]+)+)(?![A-Za-z0-9._%+-])", re.I)
_ONE_DOT = re.compile(rf"[-_](?:{_dot})[-_]", re.I)
_PIECE = re.compile(rf"\x20(?:{_at})\x20|\x20?@\x20?|\x20(?:{_dot})\x20", re.I)
#: A run of digits in which some letters stand for digits.
_LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_DIGITS_WITH_LETTERS = re.compile(r"(?<![A-Za-z0-9])[OolI]*+[0-9][0-9OolI]*+(?![A-Za-z])")
#: RE2 patterns that a text must match to be rewritten at all; linear and over whole batches.
_HINTS = (
    r"[\[({<] ?(?i:" + f"{_at}|{_dot}" + r"|@|\.) ?[\])}>]",
    r"(?i)(?: (?:" + _at + r") | @ ?|@ )[a-z0-9-]+(?:\.| (?:" + _dot + r") )[a-z0-9-]",
    r"(?i)[a-z0-9][_-](?:" + _at + r")[_-][a-z0-9]+[_-](?:" + _dot + r")[_-]",
    r"(?i)[0-9] (?:" + _dot + r") [0-9]|[0-9] (?:" + _dot + r") (?:" + _ANY_DIGIT + r")|(?:" + _ANY_DIGIT + r") (?:" + _dot + r") [0-9a-z]",
    r"(?i)@[a-z0-9.-]+ (?:" + _dot + r") [a-z0-9-]",
    r"(?i) (?:" + _dot + r") [a-z0-9_%+-]+(?:[a-z0-9._%+-]| (?:" + _dot + r") )*@",
    r"(?i)(?:" + _ANY_DIGIT + r")[ ,.;/\t\n-]{1,3}(?:" + _ANY_DIGIT + r"|[0-9])",
    r"(?i)[0-9][ ,.;/\t\n-]{1,3}(?:" + _ANY_DIGIT + r")",
    r"[0-9][OolI]|[OolI][0-9]",
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of the e-mail pattern: from every @, the run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = None
        if start < at:
            m = _DOMAIN.match(text, at + 1)
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            # the next match cannot hold this @, so it starts after it
            done = at + 1
            at = text.find("@", done)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(s, e, 0) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            raw = m[0].rstrip(" ().-")
            # the pattern wants a class character between the first and the last digit
            if len(raw) >= 4 and 10 <= sum(map(raw.count, "0123456789")) <= 15:
                found.append((m.start(), m.start() + len(raw), 3))
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


class Rewritten:
    """A text after transducers, with the source position of every piece."""

    def __init__(self, text: str):
        self.text, self.pieces = text, []  # pieces: (start, end in this text, start, end in the source), rewritten ones only
        self.words = False  # whether words were read as digits

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text, in order and apart; later passes keep the earlier pieces' source positions."""
        if not edits:
            return
        out, pieces, at, length = [], [], 0, 0
        old = self.pieces
        starts = [p[0] for p in old]
        for s, e, new in edits:
            # an old piece cut by the edit becomes part of it
            i = bisect_right(starts, s) - 1
            if i >= 0 and old[i][1] > s:
                s = old[i][0]
            j = bisect_right(starts, e - 1) - 1
            if j >= 0 and old[j][1] > e:
                e = old[j][1]
            if s < at:
                continue
            pieces += [(p[0] - at + length, p[1] - at + length, p[2], p[3]) for p in self._between(at, s)]
            out.append(self.text[at:s])
            length += s - at
            pieces.append((length, length + len(new), self.source(s, False), self.source(e, True)))
            out.append(new)
            length += len(new)
            at = e
        pieces += [(p[0] - at + length, p[1] - at + length, p[2], p[3]) for p in self._between(at, len(self.text))]
        out.append(self.text[at:])
        self.text, self.pieces = "".join(out), pieces

    def _between(self, s: int, e: int):
        starts = [p[0] for p in self.pieces]
        i = bisect_right(starts, s - 1)
        while i < len(self.pieces) and self.pieces[i][1] <= e and self.pieces[i][0] >= s:
            yield self.pieces[i]
            i += 1

    def source(self, at: int, end: bool) -> int:
        """The source position of a boundary: as a start, that of the character after it; as an end, that after the one before it."""
        starts = [p[0] for p in self.pieces]
        i = bisect_right(starts, at - (1 if end else 0)) - 1
        if i < 0:
            return at
        s, e, source_s, source_e = self.pieces[i]
        if at < e or (end and at == e):
            return source_e if end else source_s
        return source_e + at - e

    def touches(self, s: int, e: int) -> bool:
        i = bisect_right([p[0] for p in self.pieces], e - 1) - 1
        return i >= 0 and self.pieces[i][1] > s or i >= 0 and self.pieces[i][0] >= s


def _plain(c: str) -> str | None:
    """The ASCII character that c imitates."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and n != c else None


@cache
def _rewritten_class() -> str:
    """An RE2 class of every character that ``_plain`` rewrites, as ranges."""
    ranges: list[list[int]] = []
    for k in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= k < 0xE000 and _plain(chr(k)) is not None:
            if ranges and ranges[-1][1] == k - 1:
                ranges[-1][1] = k
            else:
                ranges.append([k, k])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def _characters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), p) for m in re.finditer(r"[^\x00-\x7f]", text) if (p := _plain(m[0])) is not None]


def _digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        out, at, plus = [], 0, False
        words = list(_WORD_OR_DIGITS.finditer(m[0]))
        for w in words:
            value = _DIGIT.get(w[0].lower(), w[0])
            # a dot between spelled numbers stays a dot, other separators go
            dot = _HAS_DOT.search(m[0], at, w.start()) and not plus
            out += ["." if dot else "", value] if out else [value]
            plus, at = value == "+", w.end()
        edits.append((m.start(), m.end(), "".join(out)))
    return edits


def _runs(text: str):
    """Items of runs of spelled and plain digits; a capitalised word after plain digits begins a run of its own (it begins a sentence, or is a noun)."""
    for m in _MIXED.finditer(text):
        run: list[re.Match] = []
        for w in _WORD_OR_DIGITS.finditer(text, m.start(), m.end()):
            if run and w[0][0].isupper() and not w[0].isupper() and run[-1][0][0].isdigit():
                yield run
                run = []
            run.append(w)
        yield run


def _mixed_digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for items in _runs(text):
        spelled_dot = re.search(_SPELLED_DOT, text[items[0].start() : items[-1].end()], re.I)
        if all(w[0][0].isdigit() for w in items) and not spelled_dot:
            continue
        at, plus = items[0].start(), False
        for w in items:
            if w.start() > at:
                edits.append((at, w.start(), "." if _HAS_DOT.search(text, at, w.start()) and not plus else ""))
            value = _DIGIT.get(w[0].lower(), w[0])
            if value != w[0]:
                edits.append((w.start(), w.end(), value))
            plus, at = value == "+", w.end()
    return edits


def _in_one(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _IN_ONE.finditer(text):
        if re.split(r"[-_]", m[3])[-1].lower() in _ENDINGS:
            edits.append((m.end(1), m.start(3), "@"))
            edits += [(d.start(), d.end(), ".") for d in _ONE_DOT.finditer(text, m.start(3), m.end(3))]
    return edits


#: Words that stand before "at" and a site's name in plain prose, and words that announce an address.
BEFORE_A_SITE = frozenset("""
a about all also am an and any are arrive arrived as ask available back based be been best book booked bought browse buy buying call chat check click come contact cook day
discount done down download eat else enrol event every everyone everything find for found free from get go going good got guest he hear held help her here him his home hosted hours in info interview is it item join
jobs know later learn less life listen listed live located look looked looking loved made me meet meeting more most much new news night not now of off offer on online only or
order ordered our out page photo play post posted price prices programme published read register report sale save search see seen sell selling service she shop shopping shown sign site sold some
sponsored stare stay stop store stories study subscribe talk team that the their them there they things this ticket tickets time to today together tonight up us use version video visit visited watch we web were what when where
which who work worked working works workshop write you your
""".split())


def _mailbox(text: str, start: int, end: int) -> bool:
    """Whether what stands before a spelled at and a plain site's name is a mailbox: it has digits or signs, or is no word that prose has there."""
    local = text[start:end]
    if any(not c.isalpha() for c in local):
        return True
    return local.lower() not in BEFORE_A_SITE


def _local_start(text: str, at: int) -> int:
    """Where the local part that ends at ``at`` begins: labels back to back with plain or spelled dots; ``at`` itself if there is none."""
    start = at
    while True:
        p = start
        if p < at:
            if text[p - 1 : p] == ".":
                p -= 1
            elif m := _BEHIND.search(text, max(0, p - 12), p):
                p = m.start()
            else:
                return start
        q = p
        while q and text[q - 1] in _LABEL:
            q -= 1
        if q == p:
            return start
        start = q


def _site_end(text: str, at: int) -> tuple[int, str, str]:
    """(end, last dot as spelled, last label) of the longest site from ``at`` on that ends in a known ending; end -1 if there is none."""
    m = _SITE.match(text, at)
    best = (-1, "", "")
    if m:
        for step in _STEP.finditer(text, at, m.end()):
            label = re.match(r"[A-Za-z0-9-]+", text[step.end() : step.end() + 64])
            if not label or label[0].lower() not in _ENDINGS:
                continue
            # a plain dot before a capital and one small letter ends a sentence
            if step[1] is None and _SENTENCE.match(text, step.end()):
                continue
            best = (step.end() + len(label[0]), (step[1] or "").lower(), label[0].lower())
    return best


def _spelled_mail(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for m in _AT.finditer(text):
        start = _local_start(text, m.start())
        if start == m.start() or edits and start < edits[-1][1]:
            continue
        end, dot, last = _site_end(text, m.end())
        spelled = "@" not in m[0]
        if end < 0 or dot == "point" and m[0].strip().lower() == "at" and last in WORDS_TOO:
            continue
        if spelled and not dot and not _BEHIND_ANY.search(text, start, m.start()) and not _mailbox(text, start, m.start()):
            continue
        for p in _PIECE.finditer(text, start, end):
            new = "@" if p.start() == m.start() else "."
            if p[0] != new:
                edits.append((p.start(), p.end(), new))
    return edits


def _letters(text: str) -> list[tuple[int, int, str]]:
    return [(k, k + 1, _LETTERS[text[k]]) for m in _DIGITS_WITH_LETTERS.finditer(text) for k in range(m.start(), m.end()) if text[k] in _LETTERS]


def normalised(text: str) -> list[Rewritten]:
    """The readings of a text: digits as they are, spelled runs joined, spelled digits joined to any digits beside them, letters as digits."""
    out = Rewritten(text)
    if not text.isascii():
        out.apply(_characters(out.text))
    out.apply([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(out.text)])
    out.apply([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(out.text)])
    out.apply(_in_one(out.text))
    out.apply(_spelled_mail(out.text))
    readings = [out]
    for words, edits in ((True, _digits(out.text)), (True, _mixed_digits(out.text)), (False, _letters(out.text))):
        if edits:
            more = Rewritten(out.text)
            more.words = words
            more.pieces = list(out.pieces)
            more.apply(edits)
            readings.append(more)
    return readings


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the detectors find in the normalised texts only, in source positions."""
    found: list[tuple[int, int, str]] = []
    for new in normalised(text):
        if not new.pieces:
            continue
        more = []
        for s, e, kind in detect(new.text):
            if new.touches(s, e):
                a, b = new.source(s, False), new.source(e, True)
                if any(k == kind and x <= a and b <= y for x, y, k in [*base, *found]):
                    continue
                # a number that is whole without the digit word beside it stays as it is
                if not new.words or not any(k == kind and a <= x and y <= b for x, y, k in [*base, *found]):
                    more.append((a, b, kind))
        found += more
    return found


def spans(text: str, hinted: bool = True) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    base = detect(text)
    more = added_spans(text, base) if hinted else []
    return base, sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def _hinted(column):
    """Which texts hold any disguise, by RE2 over the batch."""
    import pyarrow.compute as pc

    any_of = None
    for pattern in (*_HINTS, _rewritten_class()):
        hit = pc.match_substring_regex(column, pattern)
        any_of = hit if any_of is None else pc.or_(any_of, hit)
    return any_of.to_pylist()


def _scan(batch):
    release()
    column = batch.column("text")
    out: list[list] = [[] for _ in range(8)]
    for text, hint in zip(column.to_pylist(), _hinted(column), strict=True):
        base, found = spans(text or "", bool(hint))
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
        for column_out, value in zip(out, [*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found) - len(base), len(found)], strict=True):
            column_out.append(value)
    return out


def op7(docs: DataFrame) -> DataFrame:
    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return map_rows(docs.select("doc_id", "text"), _scan, added, ["doc_id"])


def redact(text: str, hinted: bool = True) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans, one bracket for all, named after the first."""
    _, found = spans(text, hinted)
    if not found:
        return text
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def _redact(batch):
    release()
    column = batch.column("text")
    return [[None if t is None else redact(t, bool(h)) for t, h in zip(column.to_pylist(), _hinted(column), strict=True)]]


@same_columns
def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars``, if there, follows."""
    rows = map_rows(docs, _redact, "p__text string", docs.columns)
    new = {"text": F.col("p__text"), "n_chars": F.when(F.col("n_chars").isNull(), F.lit(None)).otherwise(F.length("p__text")).cast("long")} if "n_chars" in docs.columns else {"text": F.col("p__text")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
