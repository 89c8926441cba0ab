"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 4 characters of the lower-case text; term frequency is the share of the text's
n-grams, and inverse document frequencies count every document of the corpus. The weights are learned by
follow-the-regularised-leader with proximal steps and an elastic net (McMahan et al. 2013), which leaves most at
zero; a temperature fitted on held-out documents then calibrates the probabilities.

The model is trained on a sample of at most about train_docs + held_out labelled documents, drawn by a hash of
doc_id and text (a documented bound; everything else covers all documents). Text is scored whole: a logit is the mean over
the text's n-grams of weight times inverse document frequency, so no feature vector is ever made.

Defined results: null and empty texts have a null predicted language and confidence 0. Documents without a label
aren't trained on but are classified. A label so rare that the sample has none of its documents is never predicted. Where two languages score alike, the first in alphabetical order wins. If no
document has a label, all predictions are null. Rows of one doc_id are classified one by one. Columns other than
doc_id, text and the label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.llm.textkit import U64, Texts, chunks, powers, spread, sums, texts

LENGTHS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    train_docs: int = 3_000
    held_out: int = 1_000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-3
    l2: float = 1e-4
    seed: int = 11


@dataclass
class Trained:
    languages: list[str]
    weights: np.ndarray  # by feature and language
    bias: np.ndarray
    temperature: float


def features(column: pa.Array, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram length the hashed n-grams of all texts, and the first of each text."""
    body = texts(column, lower=True)
    return features_of(body, bits)


def features_of(body: Texts, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    data = body.data
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    ends = np.append(lead[1:], len(data))
    width = ends - lead
    code = data[lead].astype(U64)
    for i in range(1, 4):
        more = np.flatnonzero(width > i)
        code[more] = (code[more] << U64(8)) | data[lead[more] + i]
    code = (code + U64(1)) * U64(0x9E3779B97F4A7C15)
    code ^= code >> U64(29)
    first = np.searchsorted(lead, body.offsets)
    hashed, firsts, run = [], [], code
    for n in LENGTHS:
        if n > 1:
            run = run[: max(0, len(code) - n + 1)] * U64(0xD6E8FEB86659FD93) + code[n - 1 :]
        # n-grams that go over the end of a text are left out
        keep = np.ones(len(run), bool)
        for back in range(1, n):
            at = first[1:-1] - back
            keep[at[(at >= 0) & (at < len(run))]] = False
        kept = np.append(0, np.cumsum(keep))
        hashed.append((((run[keep] + U64(n)) * U64(0xFF51AFD7ED558CCD)) >> U64(64 - bits)).astype(np.int32))
        firsts.append(kept[np.minimum(first, len(run))])
    return hashed, firsts


def _document_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, docs = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool), 0
        for part in chunks(batches, "text"):
            hashed, firsts = features(part.column("text"), bits)
            for i in range(part.num_rows):
                mine = [h[f[i] : f[i + 1]] for h, f in zip(hashed, firsts)]
                if len(mine[0]):
                    docs += 1
                    if sum(map(len, mine)) < 4096:
                        counts[np.unique(np.concatenate(mine))] += 1
                        continue
                    for x in mine:
                        seen[x] = True
                    counts += seen
                    for x in mine:
                        seen[x] = False
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some).astype(np.int32)), pa.array(np.append(docs, counts[some]))], ["feature", "docs"])

    return run


def inverse_frequencies(docs: DataFrame, bits: int) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the feature)) + 1 for each feature, over all of docs."""
    rows = docs.select("text").where("text <> ''").mapInArrow(_document_counts(bits), "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    feature, count = rows.column("feature").to_numpy(), rows.column("docs").to_numpy()
    total = int(count[feature < 0].sum())
    known = np.zeros(1 << bits)
    known[feature[feature >= 0]] = count[feature >= 0]
    return np.log((1 + total) / (1 + known)) + 1


def _vector(text: str, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    hashed, _ = features(pa.array([text]), bits)
    feature, count = np.unique(np.concatenate(hashed), return_counts=True)
    return feature, count / max(1, count.sum()) * idf[feature]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(labelled: list[tuple[str, str]], held_out: list[tuple[str, str]], idf: np.ndarray, s: Settings) -> Trained:
    """The model from (text, language) pairs; labelled must not be empty."""
    languages = sorted({lang for _, lang in labelled})
    k, size = len(languages), 1 << s.bits
    vectors = [_vector(text, idf, s.bits) for text, _ in labelled]
    target = np.array([languages.index(lang) for _, lang in labelled])
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(vectors)):
            feature, value = vectors[i]
            rows, x = np.append(feature, size), np.append(value * 10, 1.0)
            zi, ni = z[rows], n[rows]
            w = weights(zi, ni)
            error = softmax(x @ w)
            error[target[i]] -= 1
            g = x[:, None] * error
            more = ni + g * g
            z[rows] = zi + g - (np.sqrt(more) - np.sqrt(ni)) * s.alpha**-1 * w
            n[rows] = more
    w = weights(z, n)
    model = Trained(languages, (w[:-1] * 10 * idf[:, None]).astype(np.float32), w[-1], 1.0)
    known = [(t, lang) for t, lang in held_out if lang in languages]
    if known:
        logits = np.stack([score_texts(pa.array([t]), model, s.bits)[0][0] for t, _ in known])
        want = np.array([languages.index(lang) for _, lang in known])
        # targets smoothed as Platt did, else a model without errors would be made infinitely sure
        lo, hi, blur = -3.0, 3.0, 1 / (len(want) + 2)
        goal = np.full(logits.shape, blur / max(1, k - 1))
        goal[np.arange(len(want)), want] = 1 - blur if k > 1 else 1.0
        loss = lambda q: -(goal * np.log(np.maximum(softmax(logits / np.exp(q)), 1e-300))).sum(axis=1).mean()
        for _ in range(60):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
    return model


def score_texts(column: pa.Array, model: Trained, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each text before calibration, and its number of n-grams."""
    hashed, firsts = features(column, bits)
    total = sum(np.diff(f) for f in firsts)
    logits = np.zeros((len(column), len(model.languages)))
    for k in range(len(model.languages)):
        plane = np.ascontiguousarray(model.weights[:, k])
        for h, f in zip(hashed, firsts):
            logits[:, k] += sums(plane[h].astype(np.float64), f)
    return logits / np.maximum(total, 1)[:, None] + model.bias, total


RESULT = "doc_id long, label string, predicted string, confidence double"


def fit(docs: DataFrame, label: str, s: Settings = Settings()) -> Trained | None:
    """The model for docs; None if no document is labelled."""
    idf = inverse_frequencies(docs, s.bits)
    known = docs.where(F.col(label).isNotNull() & (F.col("text") != ""))
    share = min(1.0, (s.train_docs + s.held_out) / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit(s.seed), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = [(r["text"], r["label"]) for r in known.where(draw < share).select("doc_id", "text", F.col(label).alias("label")).orderBy(F.xxhash64(F.lit(s.seed + 1), "doc_id"), "text").toLocalIterator()]
    cut = len(rows) * s.train_docs // (s.train_docs + s.held_out)
    return train(rows[: max(1, cut)], rows[max(1, cut) :], idf, s) if rows else None


def identify(docs: DataFrame, label: str = "lang", s: Settings = Settings()) -> DataFrame:
    """doc_id, its label, the predicted language and the calibrated probability of every row of docs."""
    model = fit(docs, label, s)
    # one model of fixed size (2 ** bits features by languages) goes to each executor
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in chunks(batches, "text"):
            if model:
                logits, total = score_texts(part.column("text"), model, s.bits)
                p = softmax(logits / model.temperature)
                best, none = p.argmax(axis=1), total == 0
                names = pa.array(np.array(model.languages, object)[best], pa.string(), mask=none)
                sure = np.where(none, 0.0, p[np.arange(len(best)), best])
            else:
                names, sure = pa.nulls(part.num_rows, pa.string()), np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), names, pa.array(sure)], ["doc_id", "label", "predicted", "confidence"])

    return docs.select("doc_id", F.col(label).alias("label"), "text").mapInArrow(run, RESULT)
