"""Periodic runs of words by an online sparse diagonal DP.

A run is a longest stretch of words with smallest period q (words q apart are identical) of at least ``LEAST_WORDS`` words and ``LEAST_TIMES`` q.
Diagonal q holds the words that equal the word q before them; a stretch of m matches there is a stretch of m + q words with period q. Words are
met from left to right, their earlier occurrences lengthen the diagonals they lie on, and a diagonal that ends long enough gives its run at
once; of equal stretches that with the smallest lag, as the others are its multiples (theorem of Fine and Wilf).

What keeps the diagonals sparse: lags up to 3 are whole-array comparisons. For lags from b to 2b - 1, b a power of two, a run matches at 3b
places in a row or more, so only occurrences whose last b words match as well open a diagonal. Occurrences of b words that repeat within b / 2
words are passed over: they lie in a stretch of smaller period, and b words in a row of a run whose period is more than b / 2 cannot all do so (by
the same theorem). What remains lies more than b / 2 apart, so a word opens three diagonals per b at most, log2(n) times b. An opened diagonal
is followed by comparing words in doubling steps, so no equality rests on hashes; the time is near linear in the words of a text,
whatever they repeat.

Null, empty or blank text: no words, no runs. A text is read whole in one task, some megabytes of texts at a time; the words of unlike texts
never match. Ties are defined by the caller's order (op12: greatest length, smallest start, smallest period). Repeated rows give equal
rows; columns that are not asked for are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import map_rows, release

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of texts whose words are compared in one go (a longer text goes alone).
CHUNK = 2_000_000

Run = tuple[int, int, int]  # first word, words, period


def _least(lag: int) -> int:
    """Matches in a row that make a run."""
    return max(LEAST_WORDS - lag, (LEAST_TIMES - 1) * lag)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _equal(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, to the right (step 1) or the left (-1), equal the word ``lag`` before them."""
    done, size = 0, 16
    room = len(x) - at if step > 0 else at - lag + 1
    while done < room:
        size = min(size * 2, room - done)
        if step > 0:
            same = x[at + done : at + done + size] == x[at + done - lag : at + done - lag + size]
        else:
            end = at - done + 1
            same = (x[end - size : end] == x[end - size - lag : end - lag])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += size
    return done


def _opened(x: np.ndarray) -> Iterable[tuple[int, int, int]]:
    """(lag, first, last match) of pieces of diagonals with lags from 4 on, such that every run has a piece."""
    n, b = len(x), 4
    if n < 4 * LEAST_TIMES:
        return
    pairs = _mixed(x[:-1], x[1:])
    gram = _mixed(pairs[:-2], pairs[2:])  # of the b words from each place on
    alive = np.arange(len(gram))
    while len(alive) and LEAST_TIMES * b <= n:
        h = gram[alive]
        order = np.argsort(h, kind="stable")
        where, h = alive[order], h[order]
        gap = np.full(len(where) + 1, n, np.int64)
        gap[1:-1] = np.where(h[1:] == h[:-1], where[1:] - where[:-1], n)  # to the occurrence before, n if there is none
        twice = (gap[:-1] < n) | (gap[1:] < n)
        apart = twice & (gap[:-1] > b // 2) & (gap[1:] > b // 2)
        seen, key = where[apart], h[apart]
        lags, ends = [], []
        for k in range(1, 4):
            if len(seen) <= k:
                break
            lag = seen[k:] - seen[:-k]
            hit = (key[k:] == key[:-k]) & (lag >= b) & (lag < 2 * b)
            lags.append(lag[hit])
            ends.append(seen[k:][hit])
        if lags:
            lag, at = np.concatenate(lags), np.concatenate(ends)
            order = np.lexsort((at, lag))
            lag, at = lag[order], at[order]
            if len(lag):
                edge = np.flatnonzero((np.diff(lag) != 0) | (np.diff(at) != 1))
                for i, j in zip(np.concatenate([[0], edge + 1]).tolist(), np.append(edge, len(lag) - 1).tolist(), strict=True):
                    yield int(lag[i]), int(at[i]), int(at[j]) + b - 1
        # twice as many words repeat only where these do
        alive = np.sort(where[twice])
        alive = alive[alive < len(gram) - b]
        if len(gram) <= b:
            return
        gram = _mixed(gram[:-b], gram[b:])
        b *= 2


def diagonals(x: np.ndarray) -> list[Run]:
    """The runs of a sequence of numbers, by first word, then period."""
    found: dict[tuple[int, int], int] = {}

    def ended(first: int, last: int, lag: int) -> None:
        if last - first + 1 >= _least(lag):
            stretch = (first - lag, last)
            found[stretch] = min(lag, found.get(stretch, lag))

    for lag in range(1, 4):
        same = np.zeros(max(len(x) - lag, 0) + 2, np.int8)
        same[1:-1] = x[lag:] == x[:-lag] if len(x) > lag else 0
        turns = np.flatnonzero(np.diff(same))
        first, last = turns[::2] + lag, turns[1::2] + lag - 1
        long = last - first + 1 >= _least(lag)
        for s, e in zip(first[long].tolist(), last[long].tolist(), strict=True):
            ended(s, e, lag)
    active: dict[int, int] = {}  # lag: last word known to lie on its diagonal without a break
    for lag, first, last in sorted(_opened(x), key=lambda p: p[1]):
        if active.get(lag, -1) >= first:
            continue
        first -= _equal(x, first - 1, lag, -1)
        last += _equal(x, last + 1, lag, 1)
        active[lag] = last
        ended(first, last, lag)
    return sorted((s, e - s + 1, lag) for (s, e), lag in found.items())


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words."""
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    flat += np.repeat(np.arange(len(texts), dtype=np.uint64), sizes) << np.uint64(40)  # unlike texts share no word
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in diagonals(flat):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        out[doc].append((start - int(starts[doc]), length, period))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that lie in any run after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def _in_chunks(texts: list[bytes | None]) -> Iterable[list[list[bytes]]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append((text or b"").split())  # bytes split on the six ASCII spaces
        size += len(text or b"")
        if size > CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _texts(batch) -> list[bytes | None]:
    import pyarrow as pa

    return batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _struct(run: Run) -> dict:
    return dict(zip(("start", "length", "period"), run, strict=True))


def _found(batch):
    release()
    runs, kept = [], []
    for chunk in _in_chunks(_texts(batch)):
        for words, found in zip(chunk, find_runs(chunk), strict=True):
            runs.append([_struct(r) for r in found])
            kept.append(b" ".join(collapse(words, found)).decode())
    return [runs, kept]


def periodic_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the runs of each text, and the text without their repeats, its words joined by one space."""
    keep = list(dict.fromkeys(keep))
    added = "d__runs array<struct<start: long, length: long, period: long>>, d__text string"
    rows = map_rows(docs.select(*dict.fromkeys([*keep, "text"])), _found, added, keep)
    return rows.select(*keep, F.col("d__runs").alias("runs"), F.col("d__text").alias("collapsed"))


def loops(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end, for a tenth of the ids."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _scan(batch):
    release()
    ids = iter(batch.column("doc_id").to_pylist())
    out: list[list] = [[] for _ in range(7)]
    for chunk in _in_chunks(_texts(batch)):
        chunk = [loops(next(ids), words) for words in chunk]
        for words, found in zip(chunk, find_runs(chunk), strict=True):
            start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            row = (len(found), start, length, period, 1000 * length // period if found else None,
                   hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, found))).hexdigest())
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return out


def op12(docs: DataFrame) -> DataFrame:
    """Per document: its runs, the longest one, and digests of all runs and of the collapsed text; a tenth of the texts get a periodic end."""
    added = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_rows(docs.select("doc_id", "text"), _scan, added, ["doc_id"])
