"""Quality rules on repetition.

For each document: the share of characters inside duplicated n-grams (any word covered by an n-gram that
occurs more than once in the document, n = 5 .. 10), the largest share held by one repeated n-gram
(n = 2 .. 4), and the shares of lines, and of their characters, whose line occurs more than once.
Words are runs of characters other than ASCII white space; lines are trimmed and blank ones left out.

Hashes of longer n-grams roll on from those of shorter ones, for all documents of a slice at once.

Defined results: null and empty texts measure 0 everywhere, have n_words 0, and are kept (there is no
repetition in them; other rules judge emptiness). Texts of fewer than min_words words are measured but not
rejected for n-grams, nor those of fewer than min_lines lines for lines. Repeated rows are measured row by
row. Columns other than doc_id and text are ignored by measure() and passed through by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sorrel.llm.textkit import U64, chunks, grouped, mix, owner, sums, texts

TOP = (2, 3, 4)
COVER = (5, 6, 7, 8, 9, 10)


@dataclass(frozen=True)
class Limits:
    """Largest shares that a kept document has; the defaults are those published for Gopher (2112.11446).

    These were set for documents of fifty words and more. In a text of fewer than min_words words a single pair of words
    that occurs twice is a tenth or more of it, and in one of fewer than min_lines lines a line that does is two thirds,
    so the shares tell ordinary short texts from repetition no longer, and such texts aren't rejected by them. 0 rejects
    by share whatever the size.
    """

    top: tuple[float, ...] = (0.20, 0.18, 0.16)
    cover: tuple[float, ...] = (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)
    line: float = 0.30
    line_chars: float = 0.20
    min_words: int = 20
    min_lines: int = 4


NAMES = [f"top_{n}gram" for n in TOP] + [f"dup_{n}gram" for n in COVER] + ["dup_line", "dup_line_chars"]
MEASURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in NAMES], T.StructField("keep", T.BooleanType())])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.minimum(part / np.maximum(whole, 1), 1.0)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys that occur more than once: their positions, group by group, starts and sizes of the groups."""
    order, starts = grouped(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    many = sizes > 1
    if not many.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = order[np.repeat(many, sizes)]
    sizes = sizes[many]
    return where, np.cumsum(sizes) - sizes, sizes


def measure_column(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """The measures of each text of a column, and keep."""
    body = texts(column)
    chars = body.char_prefix()
    starts, ends, first = body.words()
    doc = owner(first)
    count = len(body)
    salt = mix(np.arange(1, count + 1, dtype=U64))
    n_words = np.diff(first)
    width = chars[ends] - chars[starts]
    run = np.append(0, np.cumsum(width))
    total = sums(width, first)
    left = first[1:][doc] - np.arange(len(starts))  # words from here to the end of the text
    word = body.hashes(starts, ends)
    rolling = word.copy()
    out: dict[str, np.ndarray] = {"n_words": n_words}
    keep = np.ones(count, bool)
    for n in range(2, max(COVER) + 1):
        rolling = rolling[: max(0, len(word) - n + 1)] * U64(0xD6E8FEB86659FD93) + word[n - 1 :]
        at = np.flatnonzero(left[: len(rolling)] >= n)
        keys = mix(rolling[at] ^ salt[doc[at]])
        where, groups, sizes = _repeated(keys)
        where = at[where]
        if n in TOP:
            share = np.zeros(count)
            if len(where):
                lead = where[groups]
                np.maximum.at(share, doc[lead], sizes * (run[lead + n] - run[lead]))
            name, limit = f"top_{n}gram", limits.top[TOP.index(n)]
        else:
            marks = np.zeros(len(starts) + 1, np.int64)
            np.add.at(marks, where, 1)
            np.add.at(marks, where + n, -1)
            share = sums(np.where(np.cumsum(marks[:-1]) > 0, width, 0), first)
            name, limit = f"dup_{n}gram", limits.cover[COVER.index(n)]
        out[name] = _share(share, total)
        keep &= (out[name] <= limit) | (n_words < limits.min_words)
    starts, ends, first = body.lines()
    doc = owner(first)
    where, _, _ = _repeated(mix(body.hashes(starts, ends) ^ salt[doc]))
    again = np.zeros(len(starts), bool)
    again[where] = True
    width, n_lines = chars[ends] - chars[starts], np.diff(first)
    out["dup_line"] = _share(sums(again, first), n_lines)
    out["dup_line_chars"] = _share(sums(np.where(again, width, 0), first), sums(width, first))
    out["keep"] = keep & (((out["dup_line"] <= limits.line) & (out["dup_line_chars"] <= limits.line_chars)) | (n_lines < limits.min_lines))
    return out


def measure(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, the eleven shares and keep of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            got = measure_column(part.column("text"), limits)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[f.name]) for f in MEASURES[1:])], MEASURES.names)

    return docs.select("doc_id", "text").mapInArrow(run, MEASURES)


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield part.filter(pa.array(measure_column(part.column("text"), limits)["keep"]))

    return docs.mapInArrow(run, docs.schema)
