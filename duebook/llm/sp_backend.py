"""SentencePiece encoding and decoding on the Tokenizers library, rebuilt from the model's protobuf.

``read_model`` takes the pieces, scores, kinds and normaliser settings out of the file; ``build`` makes a Tokenizers pipeline of them:
the precompiled character map, the metaspace marker, unigram scores or the merges that BPE scores imply, byte fallback, and the decoder
that undoes them. Where no piece continues across a marker (``separable``), a text is the sequence of its units - a marker with what
follows - and a worker encodes each distinct unit once, many in one call, keeping a bounded table between batches. ``encode_batch`` and
``decode_batch`` run on as many threads as the task has cores (``spark.task.cpus``).

Parity and round trip are checked in the job itself, for every text: the sentencepiece library encodes the same units, and the decoder
must give each unit back. Texts that are not a plain sequence of units (white space in runs or at the ends, markers in the text) and all
texts of a model that rewrites texts (character map, squeezed white space, pieces across markers) are encoded, compared and decoded whole.

Null text: null ids, no tokens, parity and round trip true. Empty text: no ids. Texts of any length, very long ones and very long words
too, are read whole; unknown characters become bytes. Repeated rows give equal rows, ties do not occur; an empty table gives none. Kept
columns that bear a result's name get ``_in`` after theirs, as often as it takes to be free.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import TOKENIZER_DIR, map_rows, resident

MARK = "▁"
MODEL = "piece_bpe_32k.model"
# Fixed values of the model format: kinds of pieces, and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Units a worker keeps between batches (about 150 bytes each), and characters of new units encoded in one call.
MOST_UNITS, RUN = 150_000, 60_000


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, 4-byte floats as bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def read_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            model.suffix = bool(trainer.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if model.suffix or not model.escape or any(k == USER for _, _, k in model.pieces):
        raise ValueError("models with white space as suffix, unescaped white space or user-defined pieces are not rebuilt")
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of kind {model.kind} (words or characters) are not rebuilt")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way two pieces make a third, best third first; the library applies them in this order."""
    scores = {p: s for p, s, k in model.pieces if k in (NORMAL, UNUSED)}
    found = [(-score, a, b) for piece, score in scores.items() for at in range(1, len(piece)) if (a := piece[:at]) in scores and (b := piece[at:]) in scores]
    found.sort(key=lambda x: x[0])  # stable: the order of the vocabulary among equal scores
    return [(a, b) for _, a, b in found]


def separable(model: Model) -> bool:
    """Texts are only marked, and no piece has a marker after another character or is missing for a marker: none crosses into the next unit."""
    marked = model.dummy_prefix and not model.squeeze and not model.charsmap
    pieces = [p for p, _, k in model.pieces if k == NORMAL]
    return marked and MARK in pieces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def build(model: Model):
    from tokenizers import Tokenizer, decoders, models, normalizers

    unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        from tokenizers import Regex

        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*undo, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else undo)
    return tokenizer


class Backend:
    """A loaded model: ids of texts, texts of ids, and the check of both against the sentencepiece library."""

    def __init__(self, path: str, threads: int = 1):
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library first runs a batch
        import sentencepiece
        from tokenizers import normalizers

        with open(path, "rb") as f:
            self.model = read_model(f.read())
        self.threads, self.units = threads, separable(self.model)
        self.tokenizer = build(self.model)
        self.normaliser = self.tokenizer.normalizer
        if self.units:
            self.tokenizer.normalizer = normalizers.Sequence([])  # units and texts come normalised
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.control = frozenset(i for i, (_, _, k) in enumerate(self.model.pieces) if k == CONTROL)
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces], bool)
        self.forget()

    def forget(self) -> None:
        """Empty the table of units that earlier batches have encoded."""
        self.known: dict[str, int] = {}
        self.new: list[str] = []
        self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.same, self.back = np.zeros(0, bool), np.zeros(0, bool)

    def _place(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = self.known[word] = len(self.known)
            self.new.append(word)
        return at

    def normalise(self, text: str) -> str:
        return self.normaliser.normalize_str(text) if text else ""

    def _tokens(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that are normalised already where the model has units."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _theirs(self, texts: list[str]) -> list[list[int]]:
        return self.reference.encode(texts, num_threads=self.threads)

    def decode(self, ids) -> list[str]:
        """The texts of lists of ids, by the library's decoder; control pieces stand for no text."""
        lists = [[int(i) for i in x if i not in self.control] for x in ids]
        return self.tokenizer.decode_batch(lists, skip_special_tokens=False)

    def _units(self, words: list[str]) -> None:
        """Add the words (units without their marker) to the table: many at once as one text, alone where a run gives anything unexpected."""
        runs, run, size = [], [], 0
        for w in words:
            run.append(w)
            size += len(w) + 1
            if size > RUN:
                runs.append(run)
                run, size = [], 0
        runs += [run] if run else []
        ours = self._tokens([MARK + MARK.join(r) for r in runs])
        theirs = self._theirs([" ".join(r) for r in runs])
        texts = self.decode(ours)
        counts, flats, sames, backs = [self.n], [self.flat], [self.same], [self.back]
        for r, mine, other, text in zip(runs, ours, theirs, texts, strict=True):
            flat = np.array(mine, np.int32)
            first = np.flatnonzero(self.begins[flat])
            if len(first) == len(r) and mine == other and text == " ".join(r) and first[0] == 0:
                counts.append(np.diff(np.append(first, len(flat))))
                flats.append(flat)
                sames.append(np.ones(len(r), bool))
                backs.append(np.ones(len(r), bool))
                continue
            each = self._tokens([MARK + w for w in r])
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            flats.append(np.fromiter((i for x in each for i in x), np.int32))
            sames.append(np.array([a == b for a, b in zip(each, self._theirs(r), strict=True)], bool))
            backs.append(np.array([a == b for a, b in zip(self.decode(each), r, strict=True)], bool))
        self.n, self.flat, self.same, self.back = map(np.concatenate, (counts, flats, sames, backs))

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        normal = [self.normalise(t) for t in texts]
        mine = self._tokens(normal if self.units else texts)
        plain = [n.replace(MARK, " ") for n in normal]
        plain = [p[1:] if self.model.dummy_prefix and p.startswith(" ") else p for p in plain]
        return [(np.array(a, np.int32), a == b, d in (t, p)) for a, b, d, t, p in zip(mine, self._theirs(texts), self.decode(mine), texts, plain, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        if len(self.known) > MOST_UNITS:
            self.forget()
        plain = [self.units and bool(t) and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t for t in texts]
        place = self._place
        runs = [np.fromiter(map(place, words := t.split(" ")), np.int64, len(words)) if p else None for t, p in zip(texts, plain, strict=True)]
        if self.new:
            new, self.new = self.new, []
            self._units(new)
        whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        start = np.concatenate([[0], np.cumsum(self.n)])
        out = []
        for run in runs:
            if run is None:
                out.append(next(whole))
                continue
            k = self.n[run]
            at = np.repeat(start[run] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
            out.append((self.flat[at], bool(self.same[run].all()), bool(self.back[run].all())))
        return out


def _cpus() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.cpus() if context else 1


def backend(path: str) -> Backend:
    return resident(("pieces", path), lambda: Backend(path, _cpus()))


def _encode(path: str):
    def compute(batch):
        texts = batch.column("text").to_pylist()
        made = backend(path).encode([t or "" for t in texts])
        ids = [None if text is None else x[0] for text, x in zip(texts, made, strict=True)]
        crcs = [zlib.crc32(x[0].astype("<i4").tobytes()) for x in made]
        return [[len(x[0]) for x in made], ids, crcs, [x[1] for x in made], [x[2] for x in made]]

    return compute


def encoded(docs: DataFrame, *keep: str, model: str = MODEL, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep``, n_tokens, ids, ids_crc32 (of little-endian 32-bit ids), parity and round_trip."""
    made = ("n_tokens", "ids", "ids_crc32", "parity", "round_trip")
    taken, names = {*docs.columns, *made}, {}
    for c in dict.fromkeys(keep):
        names[c] = c
        if c in made:
            while names[c] in taken:
                names[c] += "_in"
            taken.add(names[c])
    columns = [F.col(c).alias(n) for c, n in names.items()]
    if "text" not in names:
        columns.append(F.col("text"))
    added = "n_tokens long, ids array<int>, ids_crc32 long, parity boolean, round_trip boolean"
    rows = map_rows(docs.select(*columns), _encode(os.path.join(folder, model)), added, [*names.values()] if "text" in names else [*names.values(), "text"])
    return rows if "text" in names else rows.drop("text")


def _decode(path: str):
    def compute(batch):
        lists = batch.column("ids").to_pylist()
        texts = iter(backend(path).decode([x for x in lists if x is not None]))
        return [[None if x is None else next(texts) for x in lists]]

    return compute


def decoded(rows: DataFrame, *keep: str, model: str = MODEL, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``keep`` and decoded, the text of each row's ``ids``; null ids: null."""
    need = list(dict.fromkeys([*keep, "ids"]))
    return map_rows(rows.select(need), _decode(os.path.join(folder, model)), "decoded string", need).select(*keep, "decoded")


def op5(docs: DataFrame) -> DataFrame:
    return encoded(docs, "doc_id")
