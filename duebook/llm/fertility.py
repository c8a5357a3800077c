"""Quality rules on tokeniser fertility: characters per token, byte-fallback share and token entropy against bands per language.

Two public vocabularies read every word of every text (a word with the space before it; white space itself yields no tokens). Each
distinct word is encoded once per worker and then looked up, so a document costs array arithmetic only. Bands are quartiles of each
measure over the documents of one language in one script (of those without a language in that script) that pass the base rules, widened by a
multiple of their distance. They are drawn towards those of the script over all languages as if PRIOR further documents had them, and reach
back to the language's own by its weight; a script's are widened the more, the fewer its documents are. Those of characters per token are widened also the more, the fewer the
documents of a language are, for texts with few symbols: what symbols do to tokens is no language's. No document is measured against those of
another script: in a rare script only what lies far from the rest is rejected, and a text alone in its script is kept. Texts
without letters of a known script go by all of their language, drawn towards the whole table. So every document is judged at every size; ``n_band`` says
by how many documents of its language, ``n_script`` by how many of its script.

Null or empty text: no words, base_failed, not kept. Very long texts are read whole, some hundred texts at a time; a very long word is one
word. Repeated documents: judged alike, each row kept or rejected; ties do not occur. Columns of the operator's own have names of their own
(q__), so any other column passes. Empty table: no rows.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import TOKENIZER_DIR, bounded_broadcast, cut, map_rows, resident, same_columns, staged

SYMBOLS, SPACE = b"#*$%&|<>", bytes([0x20, *range(0x09, 0x0E)])
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Band: quartiles widened by WIDTH times their distance, taken as at least the floor (bands of near-constant measures stay open).
#: WIDTH and SHORT are fitted on half of the labels and held against the other half (README).
WIDTH = 2.0
#: A language weighs as much as its script from so many documents on. Of n documents of a script, the reach is 1 + FEW / n times as wide.
PRIOR, FEW = 10, 10
#: Vocabularies cut unlike languages into unlike lengths, so a language new to the table reaches up to 1 + NEW times as far in characters per
#: token (one of 20 documents 1.6 times, of 50 hardly farther), in texts with at most one symbol in LETTERS characters.
NEW, LETTERS = 50, 50
FLOORS = {"chars_per_token": 0.08, "chars_per_token_2": 0.06, "byte_share": 0.02, "entropy": 0.3}
#: Short texts scatter more: a text of n words may lie sqrt(1 + SHORT / n) times as far outside the quartiles.
SHORT = 200.0
#: The pattern that goes with the byte-level vocabularies (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: First code points of scripts (blocks of symbols, forms and private use are of none).
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"),
           (0x780, "thaana"), (0x7C0, "nko"), (0x800, "samaritan"), (0x860, "syriac"), (0x870, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"),
           (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "other"), (0x1780, "khmer"),
           (0x1800, "mongolian"), (0x18B0, "canadian"), (0x1900, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3000, "other"), (0x3040, "kana"), (0x3130, "hangul"),
           (0x3190, "other"), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x323B0, "other"))
#: Scripts that say nothing of a text's language.
UNKNOWN = ("none", "other")
#: Words a worker keeps between batches.
MOST_WORDS = 200_000

MEASURES = ("q__n_words long, q__word_chars long, q__n_symbols long, q__n_dup_lines long, q__n_repeat_words long, "
            "q__chars_per_token double, q__chars_per_token_2 double, q__byte_share double, q__entropy double, q__script string")


class _Vocabulary(dict):
    """Word to row of the counts below; words met for the first time wait in ``new`` until ``encode``."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
        self.is_byte = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])
        with open(os.path.join(folder, "byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_bpe = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.bytes_size[rank] = len(token)
        self.fresh()

    def fresh(self):
        self.clear()
        self.new: list[bytes] = []
        self.n1, self.n2, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def encode(self):
        if not self.new:
            return
        words = [w.decode("utf-8", "replace") for w in self.new]
        ids = self.pieces.encode(words, num_threads=1)
        n1 = np.fromiter(map(len, ids), np.int64, len(ids))
        # one call for all: no token reaches over the space before a word, so tokens belong to the word in which they start
        tokens = self.bytes_bpe.encode_ordinary(" " + " ".join(words))
        size = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words))
        starts = np.cumsum(self.bytes_size[tokens]) - self.bytes_size[tokens]
        n2 = np.bincount(np.searchsorted(np.cumsum(size), starts, "right"), minlength=len(words))
        self.n1, self.n2 = np.concatenate([self.n1, n1]), np.concatenate([self.n2, n2])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.int32, int(n1.sum()))])
        self.start = np.concatenate([[0], np.cumsum(self.n1)])
        self.new = []


def _vocabulary(folder: str) -> _Vocabulary:
    words = resident(("words", folder), lambda: _Vocabulary(folder))
    if len(words) > MOST_WORDS:
        words.fresh()
    return words


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x by document, which end at ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])


def repeat_words(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that its document holds twice or more."""
    hit = np.zeros(len(ids), bool)
    n = len(ids) - WINDOW + 1
    if n < 1:
        return hit
    h = doc[:n].astype(np.uint64)
    for k in range(WINDOW):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


_BELOW_A = bytes(range(0x41)).decode()


def script(text: str) -> str:
    """The script of most of the text's letters and other characters from A on."""
    if text.isascii():
        return "latin" if text.strip(_BELOW_A) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = points[points >= 0x41]
    if not len(points):
        return "none"
    at = np.searchsorted(np.array([s for s, _ in SCRIPTS]), points, "right") - 1
    return SCRIPTS[int(np.bincount(at).argmax())][1]


def _measure(folder: str):
    def compute(batch):
        words = _vocabulary(folder)
        texts = batch.column("text").to_pylist()
        parts, n_words, chars, symbols, dup = [], [], [], [], []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            w = raw.split()  # bytes split on the six ASCII spaces
            parts.append(np.fromiter(map(words.__getitem__, w), np.int64, len(w)))
            n_words.append(len(w))
            chars.append(len(raw.translate(None, SPACE + bytes(range(0x80, 0xC0)))))
            symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
            lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else ()
            dup.append(len(lines) - len(set(lines)))
        words.encode()
        flat = np.concatenate(parts)
        n = np.array(n_words, np.int64)
        ends, doc = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        repeats = _sums(repeat_words(flat, doc), ends)
        n1, n2 = words.n1[flat], words.n2[flat]
        tokens, tokens2 = _sums(n1, ends), _sums(n2, ends)
        # every token of every document: the words' id runs, one after the other
        at = np.repeat(words.start[flat] - np.concatenate([[0], np.cumsum(n1)[:-1]]) if len(flat) else flat, n1) + np.arange(int(n1.sum()))
        ids, owner = words.ids[at].astype(np.int64), np.repeat(doc, n1)
        fallback = np.bincount(owner, weights=words.is_byte[ids], minlength=len(n))
        key = np.sort(owner * len(words.is_byte) + ids)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        whose = key[first] // len(words.is_byte)
        safe = np.maximum(tokens, 1)
        p = count / safe[whose]
        entropy = np.bincount(whose, weights=-p * np.log2(p), minlength=len(n)) + 0.0
        chars = np.array(chars, np.int64)
        scripts = [script(t or "") for t in texts]
        return [n, chars, symbols, dup, repeats, chars / safe, chars / np.maximum(tokens2, 1), fallback / safe, np.round(entropy, 6), scripts]

    return compute


def measured(docs: DataFrame, keep: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep`` and the measures (prefixed q__), written to the shared folder: bands and verdicts both read them."""
    need = list(dict.fromkeys([*keep, "text", "lang"]))
    rows = map_rows(docs.select(need), _measure(folder), MEASURES, need)
    return staged(rows.select(*keep, F.coalesce("lang", F.concat(F.lit("script:"), "q__script")).alias("q__group"), *[c for c in rows.columns if c.startswith("q__")]))


def _bands(rows: DataFrame, failed: Column) -> DataFrame:
    """Bands for every pair of language (or script without one) and script in the table."""
    # values rounded to thousandths: the exact quartiles then come from a bounded number of counts, combined before the shuffle
    quartiles = [F.percentile(F.round(f"q__{m}", 3), F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in FLOORS]
    passed = rows.where(~failed)

    def level(name: str, *keys: str) -> DataFrame:
        stats = passed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *quartiles)
        return stats.select(*keys, F.struct("n", *FLOORS).alias(name))

    pairs = rows.select("q__group", "q__script").distinct().join(level("x__pair", "q__group", "q__script"), ["q__group", "q__script"], "left")
    pairs = pairs.join(level("x__group", "q__group"), "q__group", "left").join(level("x__script", "q__script"), "q__script", "left")
    pairs = pairs.crossJoin(F.broadcast(level("x__all")))  # one row
    unknown = F.col("q__script").isin(*UNKNOWN)
    pairs = pairs.withColumns({"own": F.when(unknown, F.col("x__group")).otherwise(F.col("x__pair")), "wide": F.when(unknown, F.col("x__all")).otherwise(F.col("x__script"))})
    n, n_wide = (F.coalesce(F.col(f"{c}.n"), F.lit(0)) for c in ("own", "wide"))
    weight = n / (n + PRIOR)
    columns = [n.cast("long").alias("q__n_band"), n_wide.cast("long").alias("q__n_script"), (1 + NEW * F.pow(1 - weight, 4)).alias("allowance")]
    for m, floor in FLOORS.items():
        edges = []
        for k, outer in ((0, F.least), (1, F.greatest)):
            far = F.col(f"wide.{m}")[k]
            own = F.coalesce(F.col(f"own.{m}")[k], far)
            drawn = weight * own + (1 - weight) * far
            edges.append((drawn, outer(drawn, weight * own + (1 - weight) * drawn)))
        (low, lowest), (high, highest) = edges
        reach = WIDTH * (1 + F.lit(FEW) / F.greatest(n_wide, F.lit(1))) * F.greatest(high - low, F.lit(floor))
        columns += [lowest.alias(f"low_{m}"), highest.alias(f"high_{m}"), reach.alias(f"reach_{m}")]
    return cut(pairs.select("q__group", "q__script", *columns))


def judged(rows: DataFrame) -> DataFrame:
    """Adds q__base_failed, q__n_band, q__n_script and q__kept."""
    failed = (F.col("q__n_words") < LEAST_WORDS) | (100 * F.col("q__n_repeat_words") > MOST_REPEAT_PERCENT * F.col("q__n_words"))
    rows = rows.withColumn("q__base_failed", failed)
    bands = _bands(rows, failed)
    inside = F.lit(True)
    scatter = F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("q__n_words"), F.lit(1)))
    allowed = F.when(LETTERS * F.col("q__n_symbols") <= F.col("q__word_chars"), F.col("allowance")).otherwise(1.0)
    for m in FLOORS:
        reach = scatter * F.col(f"reach_{m}") * (allowed if m.startswith("chars_per_token") else F.lit(1.0))
        inside &= F.coalesce(F.col(f"q__{m}").between(F.col(f"low_{m}") - reach, F.col(f"high_{m}") + reach), F.lit(True))
    joined = rows.join(bounded_broadcast(bands, bands.count(), 10_000), ["q__group", "q__script"], "left")
    return joined.withColumn("q__kept", ~F.col("q__base_failed") & inside).select(*rows.columns, "q__n_band", "q__n_script", "q__kept")


def op3(docs: DataFrame) -> DataFrame:
    rows = judged(measured(docs, ["doc_id"]))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "chars_per_token_2", "byte_share", "entropy", "n_band", "n_script")
    return rows.select("doc_id", *[F.col(f"q__{n}").alias(n) for n in names])


@same_columns
def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    return judged(measured(docs, docs.columns)).where("q__kept").select(*docs.columns)
