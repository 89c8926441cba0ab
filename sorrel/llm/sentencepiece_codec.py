"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (no generated classes), and its normaliser, metaspace marker,
scores and byte fallback are rebuilt as a tokenizers pipeline, for unigram and for BPE models.
Batches are encoded by several threads. Parity is verified as words come up: each new one is also encoded by the
sentencepiece library, and a text has parity if all its words have.

Defined results: a null text has null ids and null n_tokens; an empty text has no ids; decoding null
gives null. Ids that aren't in the vocabulary decode to nothing. A text with U+2581, which stands for a space, or with
characters that the pieces can't spell has no round trip. Words may have any length. Models with user-defined symbols,
white space as suffix or not escaped, or pieces that go over the start of a word raise ValueError. Repeated rows are encoded once per row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sorrel.llm.textkit import chunks, grouped, spread, sums, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} does not occur in SentencePiece models")
        yield tag >> 3, value


@dataclass
class Model:
    """What encoding needs of a SentencePiece model."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    space_as_suffix: bool = False

    @property
    def unk(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse_model(data: bytes) -> Model:
    """The pieces, trainer and normaliser settings of a serialised model."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for sub, raw in _fields(value):
                if sub == 1:
                    piece = raw.decode()
                elif sub == 2:
                    score = struct.unpack("<f", raw)[0]
                elif sub == 3:
                    kind = raw
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for sub, raw in _fields(value):
                if sub == 3:
                    model.kind = raw
                elif sub == 24:
                    model.space_as_suffix = bool(raw)
                elif sub == 35:
                    model.byte_fallback = bool(raw)
        elif number == 3:
            for sub, raw in _fields(value):
                if sub == 2:
                    model.charsmap = raw
                elif sub == 3:
                    model.dummy_prefix = bool(raw)
                elif sub == 4:
                    model.squeeze_spaces = bool(raw)
                elif sub == 5:
                    model.escape_spaces = bool(raw)
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.space_as_suffix or not model.escape_spaces:
        raise ValueError("models with white space as a suffix, or not escaped, can't be rebuilt")
    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with user-defined symbols can't be rebuilt")
    return model


def _merges(model: Model, vocab: dict[str, int]) -> list[tuple[str, str]]:
    """Merges in the order in which the scores apply them.

    Each piece can arise from any split into two pieces. Pieces of one score are merged leftmost first;
    putting the longer piece first among them has that effect for runs of the same character.
    """
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in vocab and right in vocab:
                    found.append((-score, -len(piece), vocab[left], vocab[right], left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


def build(model: Model):
    """A tokenizers.Tokenizer with the model's results."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    if model.squeeze_spaces:  # at the end the library strips marks that the text had, too
        steps.append(normalizers.Replace(Regex(rf"{MARK}+\z"), ""))
    if model.kind == UNIGRAM:
        core = models.Unigram([(piece, score) for piece, score, _ in model.pieces], model.unk, model.byte_fallback)
    else:
        ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        plain = {piece: ids[piece] for piece, _, kind in model.pieces if kind == NORMAL}
        core = models.BPE(ids, _merges(model, plain), unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    if all(MARK not in piece.lstrip(MARK) for piece, _, _ in model.pieces):  # so words don't depend on each other
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return out


class WordCodec:
    """Encodes texts word by word: every distinct word of a batch goes once through the tokenizer.

    A word is a run of spaces and the other characters up to the next space. No piece goes on past the
    start of a word, which the constructor checks, so the ids of a text are those of its words in order.
    Words are known by 64-bit hashes; the memory keeps keep of them and then starts anew.
    """

    def __init__(self, model: Model, keep: int = 100_000, library=None):
        if any(MARK in piece.lstrip(MARK) for piece, _, _ in model.pieces):
            raise ValueError("pieces that go over the start of a word: encode whole texts with build()")
        self.library, self.unk, self.scores = library, model.unk, [score for _, score, _ in model.pieces]
        self.prepared = bool(model.charsmap) or model.squeeze_spaces
        self.prefix = model.dummy_prefix
        self.words = build(model)
        self.normalizer = self.words.normalizer
        self.words.normalizer = None
        self.words.pre_tokenizer = None
        self.keep = keep
        plain = [bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace(MARK, " ").encode() for t, _, kind in model.pieces]
        self.piece_bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.piece_at = np.cumsum([0] + [len(p) for p in plain])
        self.forget()

    def forget(self) -> None:
        self.seen: dict[int, int] = {}
        self.ids, self.at, self.fine, self.equal = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def _tied(self, a: list[int], b: list[int]) -> bool:
        return a.count(self.unk) == b.count(self.unk) and abs(sum(self.scores[i] for i in a) - sum(self.scores[i] for i in b)) < 1e-3

    def learn(self, names: list[int], fresh: list[str], sizes: np.ndarray, spelled: np.ndarray) -> None:
        """Ids of new words, whether their pieces spell them, and whether the library gives the same; sizes and spelled have the words' bytes."""
        coded = [e.ids for e in self.words.encode_batch_fast(fresh, add_special_tokens=False)]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int32, int(n.sum()))
        to = np.append(0, np.cumsum(n))
        wide = np.diff(self.piece_at)[ids]
        total = np.append(0, np.cumsum(wide))
        fine = total[to[1:]] - total[to[:-1]] == sizes
        if fine.all():  # else words and pieces don't lie side by side
            back = self.piece_bytes[spread(self.piece_at[ids], wide)]
            wrong = np.append(0, np.cumsum(back != spelled))
            fine = np.diff(wrong[total[to]]) == 0
        else:
            joined = [b"".join(self.piece_bytes[self.piece_at[i] : self.piece_at[i + 1]].tobytes() for i in x) for x in coded]
            fine = np.array([a == b.replace(MARK, " ").encode() for a, b in zip(joined, fresh)])
        self.seen.update(zip(names, range(len(self.fine), len(self.fine) + len(names))))
        equal = np.ones(len(coded), bool)
        if self.library:
            again = self.library.encode([w[1:] if self.prefix else w for w in fresh])
            # alone, a word that is only a mark is nothing to a library that strips it; splits of one score are equal
            equal = np.array([a == b or not b and not w.strip(MARK) or self._tied(a, b) for a, b, w in zip(coded, again, fresh)])
        self.ids, self.fine, self.equal = np.append(self.ids, ids), np.append(self.fine, fine), np.append(self.equal, equal)
        self.at = np.append(self.at, self.at[-1] + to[1:])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the offset of each text's ids, whether decoding them gives the text, and parity; nulls count as empty."""
        marked = pc.fill_null(pc.match_substring(column, MARK), False).to_numpy(zero_copy_only=False)
        column = pc.fill_null(column.cast(pa.large_string()), "")
        empty = pc.equal(pc.binary_length(column), 0)
        if self.prepared:
            column = pa.array([self.normalizer.normalize_str(t) for t in column.to_pylist()], pa.large_string())
        elif self.prefix:
            column = pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        body = texts(pc.replace_substring(column, MARK, " "))
        if not len(body.data):
            return np.zeros(0, np.int32), np.zeros(len(body) + 1, np.int64), ~marked, np.ones(len(body), bool)
        space = body.data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[body.offsets[:-1][body.offsets[:-1] < len(body.data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(body.data))
        keys = body.hashes(starts, ends)
        order, groups = grouped(keys)
        sample = order[groups]
        names = keys[sample].tolist()
        if len(self.seen) > self.keep:
            self.forget()
        seen = self.seen
        new = np.array([k not in seen for k in names])
        if new.any():
            pick = sample[new]
            a, b = starts[pick], ends[pick]
            whole, chars = body.data.tobytes().decode().replace(" ", MARK), body.char_prefix()
            fresh = [whole[x:y] for x, y in zip(chars[a].tolist(), chars[b].tolist())]
            self.learn(keys[pick].tolist(), fresh, b - a, body.data[spread(a, b - a)])
        known = np.fromiter(map(seen.__getitem__, names), np.int64, len(names))
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(known, np.diff(np.append(groups, len(keys))))
        n = np.diff(self.at)[which]
        to = np.append(0, np.cumsum(n))
        first = np.searchsorted(starts, body.offsets)
        return self.ids[spread(self.at[which], n)], to[first], (sums(~self.fine[which], first) == 0) & ~marked, sums(~self.equal[which], first) == 0


_loaded: dict[str, WordCodec] = {}


def load(path: str, threads: int = 2) -> WordCodec:
    """The codec of a model file, built once per Python process, with so many threads for its batches."""
    if path not in _loaded:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            _loaded[path] = WordCodec(parse_model(f.read()), library=SentencePieceProcessor(model_file=path, num_threads=threads))
    return _loaded[path]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])


def encode(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip (decoding gives the text as normalised) and parity of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path, threads)
        for part in chunks(batches, "text"):
            null = part.column("text").is_null().to_numpy(zero_copy_only=False)
            ids, offsets, fine, equal = codec.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(offsets).astype(np.int32), mask=null), pa.array(fine, mask=null), pa.array(equal, mask=null)], ENCODED.names)

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """doc_id and text of rows of token_ids; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path, threads).words
        size = codec.get_vocab_size()
        for part in batches:
            ids = part.column("token_ids").to_pylist()
            known = [[i for i in x or [] if i is not None and 0 <= i < size] for x in ids]
            back = codec.decode_batch(known, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, back)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
