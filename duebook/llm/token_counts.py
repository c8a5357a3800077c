"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, with a byte-level vocabulary. Each token's bytes are mapped to a span of code points, and the spans
are interval-joined to sections given as sorted, disjoint spans of the same text: a token goes to every section it touches, as a whole
(rules ``start``, ``most``) or in parts (rule ``split``). Tokens are never re-encoded per section, so the counts add up to the document's.

Rules for a token that crosses a boundary: ``start`` - the section that holds its first character; ``most`` - the section that holds most
of its characters, the earlier of equals; ``split`` - each section in the share of its characters. A token inside a character (bytes of one
code point) spans that character. Characters outside every section give their tokens to section -1, so nothing is lost.

The query's sections are the lines of a text, each with its line break. Null or empty text: one section 0 of no characters and tokens, so
every document has a row. Very long texts are encoded whole, one at a time, also where they are one word. Ties do not occur: sections are
disjoint, and rule ``most`` names the earlier of equals. Repeated rows give equal rows; an empty table none. Kept columns keep their names, and
no other column is read.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import TOKENIZER_DIR, map_rows, resident

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RULES = ("start", "most", "split")


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        from duebook.llm.fertility import BYTE_PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points; a token that starts or ends inside a character includes it."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        if text.isascii():
            return starts, ends
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        # characters begun before each byte position, and up to and including it
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at_start = np.append((raw & 0xC0) != 0x80, True)
        return begun[starts] - ~at_start[starts], begun[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, and in the last place those outside every section; sections that overlap, run backwards or are out of order are refused."""
    n = len(left)
    if (left > right).any() or (left[1:] < right[:-1]).any():
        raise ValueError("sections overlap or are out of order")
    out = np.zeros(n + 1, float if rule == "split" else np.int64)
    if not len(starts):
        return out
    if not n:
        out[-1] = len(starts)
        return out
    first = np.searchsorted(right, starts, "right")  # the first section that ends after the token's start
    last = np.searchsorted(left, ends, "left") - 1  # the last that begins before its end
    if rule == "start":
        inside = (first < n) & (left[np.minimum(first, n - 1)] <= starts)
        np.add.at(out, np.where(inside, first, n), 1)
        return out
    one = (first == last) & (left[np.minimum(first, n - 1)] <= starts) & (ends <= right[np.minimum(first, n - 1)])
    out += np.bincount(first[one], minlength=n + 1)[: n + 1].astype(out.dtype)
    for k in np.flatnonzero(~one):  # tokens across a boundary only
        s, e = starts[k], ends[k]
        each = [(min(e, right[j]) - max(s, left[j]), j) for j in range(first[k], last[k] + 1)]
        outside = (e - s) - sum(c for c, _ in each)
        if rule == "split":
            for c, j in each:
                out[j] += c / (e - s)
            out[n] += outside / (e - s)
        else:
            best = max(each, key=lambda x: (x[0], -x[1]), default=(0, n))
            out[best[1] if best[0] >= outside else n] += 1
    return out


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their breaks, as spans that cover the text."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    right = np.array(ends, np.int64)
    return np.concatenate([[0], right[:-1]]), right


def _count(path: str, rule: str, sections):
    def compute(batch):
        one, out, totals = resident(("offsets", path), lambda: Encoder(path)), [], []
        for text, given in zip(batch.column("text").to_pylist(), batch.column("a__sections").to_pylist() if sections else [None] * batch.num_rows, strict=True):
            text = text or ""
            starts, ends = one.spans(text)
            if sections:
                given = sorted((int(s["start"]), int(s["end"])) for s in given or ())
                left, right = np.array([g[0] for g in given], np.int64), np.array([g[1] for g in given], np.int64)
            else:
                left, right = lines(text)
            counts = attribute(starts, ends, left, right, rule)
            rows = [{"section": k, "start": int(left[k]), "end": int(right[k]), "n_tokens": float(counts[k])} for k in range(len(left))]
            if sections and counts[-1]:
                rows.append({"section": -1, "start": None, "end": None, "n_tokens": float(counts[-1])})
            out.append(rows)
            totals.append(len(starts))
        return [totals, out]

    return compute


def token_counts(docs: DataFrame, *keep: str, rule: str = "start", sections: str | None = None, vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep``, doc_tokens, section, start, end, n_tokens: a row per section. ``sections`` names a column of structs (start, end) of the
    text's code points; by default sections are lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [*keep, F.col("text").alias("text")] if "text" not in keep else [*keep]
    if sections:
        columns.append(F.col(sections).alias("a__sections"))
    added = "doc_tokens long, a__rows array<struct<section int, start long, end long, n_tokens double>>"
    rows = map_rows(docs.select(*columns), _count(os.path.join(folder, vocabulary), rule, bool(sections)), added, list(keep))
    return rows.select(*keep, "doc_tokens", F.inline("a__rows"))


def op1(docs: DataFrame) -> DataFrame:
    rows = token_counts(docs, "doc_id", rule="start")
    return rows.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")
