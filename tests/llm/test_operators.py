"""The ten operators against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import math
import os
import random
import re
import struct
import time
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sorrel.llm import exact_dedup, language_id, mixing, ngram_join, partenum, prefix, quality, queries, secret_scan, sentencepiece_codec, sql, substring_dedup, warc_fixity, wrappers
from tests.compare import duck, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
#: Nulls in every column, empty and long texts, ties, repeated rows, and columns that operators use names of.
ODD = [
    (1, None, None, None, None),
    (1, None, "en", "src1", 0),
    (None, "a text without an id", "en", "src2", 20),
    (None, "a text without an id", "en", "src2", 20),
    (2, "", "en", "src1", 0),
    (3, "", None, "src2", 0),
    (4, "same words here " * 30, "en", "src1", 480),
    (4, "same words here " * 30, "en", "src1", 480),
    (5, "same words here " * 30, "de", None, 480),
    (6, " \n\t ", "en", "src3", 4),
    (7, " ".join(f"w{i}" for i in range(60_000)), "fr", "src4", 1),
    (8, "Über straße 日本語 \U0001f600 ﬁ", "de", "src2", 20),
    (9, 'password = "hunter2hunter2"', "en", "src1", 28),
]
CLASH = ["keep", "node", "digest", "winner", "shard", "gone", "stays", "id", "times", "epochs", "number", "planned_source", "anchor", "root", "label", "sign", "stream"]


def docs_of(spark, rows, schema=DOCS, extra=True):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)) if extra else df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def noise(seed, n, vocabulary=40):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefgh") + str(r.randrange(vocabulary)) for _ in range(r.randrange(0, 90))) for _ in range(n)]


# 1 quality rules


def brute_quality(text, limits=quality.Limits()):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")
    total, out = sum(map(len, words)), {}
    good = True
    for n in (*quality.TOP, *quality.COVER):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        if n in quality.TOP:
            mass = max((c * sum(map(len, g)) for g, c in count.items() if c > 1), default=0)
            name, limit = f"top_{n}gram", limits.top[quality.TOP.index(n)]
        else:
            covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}
            mass = sum(len(words[j]) for j in covered)
            name, limit = f"dup_{n}gram", limits.cover[quality.COVER.index(n)]
        out[name] = min(1.0, mass / max(1, total))
        good &= out[name] <= limit or len(words) < limits.min_words
    lines = [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in (text or "").split("\n")) if x]
    count = Counter(lines)
    again = [x for x in lines if count[x] > 1]
    out["dup_line"], out["dup_line_chars"] = len(again) / max(1, len(lines)), sum(map(len, again)) / max(1, sum(map(len, lines)))
    good &= (out["dup_line"] <= limits.line and out["dup_line_chars"] <= limits.line_chars) or len(lines) < limits.min_lines
    return out | {"n_words": len(words), "keep": good}


def test_quality(spark):
    texts = [None, "", " \n", "a\nb\na\n", *noise(1, 40, 3), *(("x y z\n" * k) + n.replace(" ", "\n") for k, n in enumerate(noise(2, 20))), "é ü " * 40]
    got = {r["doc_id"]: r.asDict() for r in quality.measure(docs_of(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = brute_quality(t)
        assert got[i]["keep"] == want.pop("keep"), t
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: got[i][k] for k in want}


def test_quality_keeps_columns(odd, none):
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and rows(kept.select("doc_id", "text")) == rows(odd.where("doc_id is null or doc_id not in (4, 5)").select("doc_id", "text"))
    assert quality.keep(none).count() == quality.measure(none).count() == 0


# 10 exact dedup


def brute_exact(found):
    by = defaultdict(list)
    for d, t, s in found:
        by[(t,) if t is not None else (None, object())].append((d, bool(re.match(r"src\d*[02468]$", s or ""))))
    out = []
    last = lambda d: (d is None, d or 0)
    for members in by.values():
        old = [d for d, b in members if b]
        out.append((sorted(old or [d for d, _ in members], key=last)[0], bool(old), sorted((d for d, _ in members), key=last)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [None, 3])
def test_exact_dedup(spark, odd, shards):
    r = random.Random(5)
    found = [(r.choice([None, *range(300)]), r.choice([None, "", *(f"text {i}" for i in range(60))]), r.choice([None, "web", *(f"src{i}" for i in range(5))])) for _ in range(400)]
    df = docs_of(spark, [(d, t, None, s, None) for d, t, s in found])
    want = [(d, w, h) for w, h, ids in brute_exact(found) for d in ids]
    assert rows(exact_dedup.groups(df, queries.ingested_before(), shards)) == sorted(want, key=str)
    kept = exact_dedup.keep(df, queries.ingested_before(), shards)
    assert kept.columns == df.columns
    assert kept.where("text is not null").count() == len({t for _, t, _ in found if t is not None})
    winners = sorted((d for d, _, _ in brute_exact(found)), key=str)
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == winners
    assert rows(exact_dedup.keep(odd, queries.ingested_before()).select("doc_id"))[:2] == [(1,), (1,)]


def test_exact_dedup_without_history(spark, monkeypatch):
    """New digests alone make the shards, and one text may have most of the rows."""
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    texts = ["the same text"] * 3000 + [f"text {i}" for i in range(400)]
    df = docs_of(spark, [(i, t, None, "src1", None) for i, t in enumerate(texts)])
    got = exact_dedup.groups(df, queries.ingested_before()).collect()
    assert sorted((r["doc_id"], r["winner"]) for r in got) == [(i, i if t != texts[0] else 0) for i, t in enumerate(texts)]
    assert exact_dedup.keep(df, queries.ingested_before()).count() == 401


def test_perfect_hash():
    lanes = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint64).reshape(-1, 4)
    found = exact_dedup.PerfectHash.build(lanes)
    assert sorted(found.slots(lanes)) == list(range(5000))
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(lanes[[0, 0]])


# 2 n-gram Jaccard join


def brute_classes(found, n=1, threshold=0.8):
    """doc_id, class_id, n_links and set of every document, all pairs compared."""
    docs = set()
    for d, t in found:
        w = WORD.findall((t or "").lower())
        if d is not None:
            docs.add((d, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None))
    docs = sorted(docs, key=lambda x: (x[0], str(sorted(x[1] or ()))))
    root, links = list(range(len(docs))), [0] * len(docs)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, x) in enumerate(docs):
        for j in range(i + 1, len(docs)):
            y = docs[j][1]
            if x and y and (x == y or len(x & y) / len(x | y) >= threshold):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(d, docs[top(i)][0], links[i], s) for i, (d, s) in enumerate(docs)]


def near_copies(seed, n):
    r, out = random.Random(seed), []
    for i in range(n):
        words = [r.choice("klmnop") + str(r.randrange(3000)) for _ in range(r.choice([1, 4, 15, 60, 200, 900]))]
        out.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 2])):
            share = r.uniform(0, 0.12)
            out.append(" ".join(w if r.random() > share else "z" + str(r.randrange(9999)) for w in words))
    return out


def classes_of(spark, found, n=1):
    df = docs_of(spark, [(d, t, None, None, None) for d, t in found])
    return rows(ngram_join.classes(df, ngram_join.Join(n=n)))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_join(spark, n):
    texts = near_copies(3, 150) + noise(4, 20)
    eight = [f"q{i}" for i in range(8)]
    texts = [None, "", "...", *texts, texts[5], texts[9].upper(), " ".join(eight), *(" ".join(eight[:i] + eight[i + 1 :]) for i in range(8))]
    found = list(enumerate(texts)) + [(None, texts[5]), (7, texts[9]), (7, texts[9]), (7, texts[11])]
    assert classes_of(spark, found, n) == sorted((x[:3] for x in brute_classes(found, n)), key=str)


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """Hundreds of near copies of one text, compared in several blocks, with copies of one of them, and others that share half of it."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 60)
    r = random.Random(1)
    words = [f"v{i}" for i in range(80)]
    texts = [" ".join(w if r.random() > 0.04 else f"u{r.randrange(9999)}" for w in words) for _ in range(220)]
    texts += [texts[3]] * 150 + [" ".join(words[:40] + [f"t{r.randrange(9999)}" for _ in range(40)]) for _ in range(80)]
    found = list(enumerate(texts))
    assert classes_of(spark, found) == sorted((x[:3] for x in brute_classes(found)), key=str)


def test_keep_one_of_a_large_group(spark, monkeypatch):
    """One group of near copies, a chain whose ends are unlike, a second cluster tied to it by one text, and texts alone, in several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 60)
    monkeypatch.setattr(ngram_join, "CENTRES", 4)
    monkeypatch.setattr(ngram_join, "_groups", lambda sets, threshold: ngram_join.stored(sets.where("id = rep and size > 0").select("id", F.lit(0).cast("long").alias("root")), "id"))
    r = random.Random(2)
    words, chain = [f"v{i}" for i in range(80)], [f"c{i}" for i in range(640)]
    texts = [" ".join(w if r.random() > 0.04 else f"u{r.randrange(9999)}" for w in words) for _ in range(200)]
    texts += [" ".join(chain[i : i + 40]) for i in range(0, 600, 4)]
    texts += [" ".join(chain[596:636] + [f"d{r.randrange(3)}" for _ in range(3)]) for _ in range(40)]
    texts += [" ".join(f"t{r.randrange(9999)}" for _ in range(r.randrange(20, 90))) for _ in range(90)] + [texts[7], texts[7].upper(), texts[250]]
    r.shuffle(texts)
    found = list(enumerate(texts))
    stay = [d for d, c, _, _ in brute_classes(found) if d == c]
    kept = ngram_join.keep_one(docs_of(spark, [(d, t, None, None, None) for d, t in found]))
    assert sorted(r["doc_id"] for r in kept.collect()) == stay and 90 < len(stay) < 100


@pytest.mark.parametrize("sets", [10, 10_000_000])
def test_every_pair_shares_a_signature(sets):
    """For every set size, pairs as far apart as the threshold allows, as if in a corpus of so many sets, half of the features common."""
    r = np.random.default_rng(5)
    counts = np.where(r.random(1 << partenum.CELLS) < 0.5, sets // 3, 1)
    weights = partenum.Weights.of(counts, sets)
    for size in [*range(1, 121), 150, 200, 400]:
        pairs = [(gone, new) for gone, new in ((size // 9, size // 9), (size // 5, 0), (size // 6, size // 30)) if (size - gone) / (size + new) >= 0.8]
        sets_ = []
        for gone, new in pairs * 20:
            whole = r.integers(0, 2**32, size + new)
            sets_ += [whole[:size], whole[gone:]]
        first = np.append(0, np.cumsum([len(x) for x in sets_]))
        signs, which, own = partenum.signatures(np.concatenate(sets_).astype(np.uint32), first, 0.8, weights)
        of = [({*signs[which == i].tolist()}, {*signs[(which == i) & own].tolist()}) for i in range(len(sets_))]
        assert all(a[0] & b[1] or a[1] & b[0] for a, b in zip(of[::2], of[1::2])), size


def test_meet():
    """Whatever a group's size, every pair of it is given, or stands behind a pair of centres or one centre."""
    r = np.random.default_rng(2)
    sizes = [1, 2, 5, 8, 9, 30, 200]
    sign = np.repeat(np.arange(len(sizes)).astype(np.uint64), sizes)
    ids, sketch, own = np.arange(len(sign)), r.choice(np.array([0, 1, 7, 65535, 65000], np.uint16), len(sign)), r.random(len(sign)) < 0.5
    own[sign == 3] = False
    pairs, ties = partenum.meet(sign, ids, own, sketch)
    head = {b: a for a, b in ties.tolist()}
    met = {tuple(sorted(x)) for x in pairs.tolist()}
    for i in ids:
        for j in ids[i + 1 :]:
            a, b = sorted((head.get(i, i), head.get(j, j)))
            same = sign[i] == sign[j] and (own[i] or own[j])
            assert (a == b or (a, b) in met) >= same and ((i, j) not in met or sign[i] == sign[j])
    where, mine = ids.copy(), own.copy()
    send, behind = partenum.cool(sign, where, mine, sketch)
    assert send[sign < 6].all() and set(behind[:, 1]) == set(ids[~send]) and mine[sign == 6].all()
    value = np.sort(r.integers(0, 1 << partenum.VALUE, 500)).astype(np.uint64)
    place, flag, marks = r.integers(0, 2048, 500), r.random(500) < 0.5, r.integers(0, 65536, 2048).astype(np.uint16)
    back = partenum.unpack(partenum.pack(value, place, flag, marks))
    assert all((x == y).all() for x, y in zip(back, (value, place, flag, marks[place])))


@pytest.mark.parametrize("long", [1000, 5])
@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_similar_sets_hang_together(monkeypatch, threshold, long):
    """Every pair of sets that reaches the threshold is connected by the lists of first features, packed and unpacked."""
    monkeypatch.setattr(prefix, "LONG", long)
    monkeypatch.setattr(prefix, "AT_ONCE", 500)
    r, sets_ = np.random.default_rng(6), []
    for k in range(150):
        base = np.unique(mix_of(r.choice(3000 if k % 2 else 400, int(r.choice([1, 2, 3, 5, 9, 20, 80, 200])), replace=False)))
        sets_.append(base)
        for _ in range(2):
            near = np.append(base[r.random(len(base)) > r.uniform(0, 0.15)], r.integers(0, 2**32, int(len(base) * r.uniform(0, 0.12))))
            sets_ += [np.unique(near)] if len(near) else []
    first, features = np.append(0, np.cumsum([len(x) for x in sets_])), np.concatenate(sets_).astype(np.uint32)
    order = prefix.ranks(np.where(r.random(1 << partenum.CELLS) < 0.5, 1000, 1))
    value, which, place = prefix.heads(features, first, order, threshold, np.ones(len(sets_), bool))
    sort = np.argsort(value)
    packed = prefix.pack(value[sort], which[sort], place[sort], np.arange(len(sets_)), *partenum.bitmaps(features, first), np.diff(first))
    back, of, there, present, sizes, maps = prefix.unpack(packed)
    assert (back == value[sort]).all() and (present[of] == which[sort]).all() and (there == place[sort]).all() and (sizes == np.diff(first)[present]).all()
    pairs = list(prefix.Lists(back, of, there, sizes, maps, np.ones(len(present), bool), threshold).joined())
    root = ngram_join.least_joined(*(present[np.concatenate(x)] for x in zip(*pairs)), len(sets_))
    wholes, links = [set(x.tolist()) for x in sets_], 0
    for i, x in enumerate(wholes):
        for j, y in enumerate(wholes[:i]):
            if len(x & y) >= threshold * len(x | y):
                links += 1
                assert root[i] == root[j]
    assert links > 150


def test_a_bucket_takes_little_memory():
    """Two million pairs of sets that meet by one of five features are all looked at, in slices; similar ones hang together."""
    r = np.random.default_rng(8)
    rare, counts = r.integers(0, 2**32, 5, dtype=np.uint32), np.full(1 << partenum.CELLS, 1000)
    counts[partenum.cells(rare)] = 1
    sets_ = [np.append(r.integers(0, 2**32, 299, dtype=np.uint32), rare[i // 900]) for i in range(4500)]
    sets_[1::90] = [np.append(r.integers(0, 2**32, 20, dtype=np.uint32), x[20:]) for x in sets_[::90]]
    sets_ = [np.unique(x) for x in sets_]
    first, features = np.append(0, np.cumsum([len(x) for x in sets_])), np.concatenate(sets_)
    maps, at = partenum.bitmaps(features, first)
    blobs = [pa.array([x[a:b].tobytes() for a, b in zip(to, to[1:])], pa.binary()) for x, to in ((features, first), (maps, at))]
    reps = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets_))), *blobs], ["id", "features", "bitmap"])
    lows = partenum.bands(0.8, 300)
    dense = np.zeros(len(lows), bool)
    sent = list(ngram_join._sent(0.8, SimpleNamespace(value=prefix.ranks(counts)), dense, lows, 1)(iter([reps])))
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(ngram_join._hang(0.8, dense, lows)(iter(sent)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    root = ngram_join.least_joined(*(c.to_numpy() for c in got.columns), len(sets_))
    assert (root[::90] == root[1::90]).all() and (root[::90] != root[2::90]).all()
    assert peak < 80_000_000


def mix_of(numbers):
    return numbers.astype(np.int64) * 2654435761 % 2**32


@pytest.mark.parametrize("dense", [0, 120, 1e9])
def test_ngram_join_by_both_ways(spark, monkeypatch, dense):
    """All bands by signatures, some, or none: classes and links are the same as those of all pairs."""
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    found = list(enumerate(near_copies(5, 150) + noise(6, 40)))
    assert classes_of(spark, found) == sorted((x[:3] for x in brute_classes(found)), key=str)


def test_ngram_join_sends_little(spark):
    """To find that unlike texts are unlike, less is shuffled than the texts hold."""
    r = random.Random(2)
    texts = [" ".join({f"w{int(3000 ** r.random())}x{r.randrange(40)}" for _ in range(250)}) for _ in range(3000)]
    sets = ngram_join.stored(ngram_join.sets_of(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), 1), "sets")
    before = shuffled(spark)
    assert ngram_join._groups(sets, 0.8).count() == 0
    assert 0 < shuffled(spark) - before < sum(map(len, texts))


def shuffled(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_bitmaps():
    r = np.random.default_rng(3)
    sets_ = [r.choice(3000, n, replace=False).astype(np.uint32) for n in (1, 5, 60, 90, 200, 500, 1500)]
    maps, at = partenum.bitmaps(np.concatenate(sets_), np.append(0, np.cumsum([len(s) for s in sets_])))
    blobs = [maps[a:b].tobytes() for a, b in zip(at, at[1:])]
    for i, x in enumerate(sets_):
        apart = partenum.apart([blobs[i]] * len(sets_), blobs)
        assert apart[i] == 0 and all(d <= len(np.setxor1d(x, y)) for d, y in zip(apart, sets_))


@pytest.mark.parametrize("size", [20, 60, 100, 160, 210, 400])
def test_bitmaps_tell_unlike_sets(size):
    """Of unlike sets of one size, fewer than one pair in a thousand is taken for similar, so that chance connects few."""
    r = np.random.default_rng(size)
    vocabulary = r.integers(0, 2**32, 20 * size)
    sets_ = [np.unique(r.choice(vocabulary, size, replace=False)).astype(np.uint32) for _ in range(400)]
    maps, at = partenum.bitmaps(np.concatenate(sets_), np.append(0, np.cumsum([len(s) for s in sets_])))
    blobs = [maps[a:b].tobytes() for a, b in zip(at, at[1:])]
    wrong = sum(int((partenum.apart([blobs[i]] * i, blobs[:i]) <= partenum.differences(0.8, 2 * size)).sum()) for i in range(1, len(blobs)))
    assert wrong < 400 * 399 / 2 / 1000


def test_components(spark, monkeypatch):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1900, 2100)]
    df = spark.createDataFrame(edges, "doc_a long, doc_b long")
    here = rows(ngram_join.components(df))
    monkeypatch.setattr(ngram_join, "ONE_TASK", -1)
    assert rows(ngram_join.components(df)) == here and (1060, 1000) in here and (2050, 1900) in here


def test_keep_one(spark, odd, none):
    found = list(enumerate(near_copies(8, 60)))
    other = (0, "another text of the first document 1 2 3 4 5 6 7")
    df = docs_of(spark, [(d, t, None, None, None) for d, t in [*found, other, (900, other[1] + " 8")]])
    stay = {d for d, c, _, _ in brute_classes(found) if d == c}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(df).collect()) == sorted([*stay, 0])
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([d for d, *_ in ODD if d != 5], key=str)
    assert rows(ngram_join.classes(odd)) == sorted((x[:3] for x in brute_classes([r[:2] for r in ODD])), key=str)
    assert ngram_join.keep_one(none).count() == ngram_join.classes(none).count() == 0


def test_ngram_join_sql(spark, sf_dir, con):
    same(queries.op2_ngram_join(spark, sf_dir), con, sql.ngram_join())


# 3 mixing


def test_water_fill():
    size, weight = pd.Series([100.0, 10.0, 1000.0, 0.0]), pd.Series([1.0, 1.0, 1.0, 1.0])
    got = mixing.water_fill(size, weight, 1110, 4)
    assert got.tolist() == [400.0, 40.0, 670.0, 0.0]
    assert mixing.water_fill(size, weight, 1e9, 4).tolist() == [400.0, 40.0, 4000.0, 0.0]
    assert mixing.water_fill(size, pd.Series([1.0, None, -1.0, 1.0]), 50, 4).tolist() == [50.0, 0.0, 0.0, 0.0]


def test_mixing(spark, odd, none, sf_dir, con):
    planned = mixing.plan(odd, mixing.tempered(0.7), 1.0, 4.0)
    epochs = {r["source"]: r["epochs"] for r in planned.collect()}
    assert epochs[None] > 0 and epochs["src3"] == 4.0
    got = mixing.sample(odd, planned, 7)
    want = Counter()
    for d, _, _, s, _ in ODD:
        draw = int(hashlib.md5(f"7:{'' if d is None else d}".encode()).hexdigest()[:12], 16) / 2**48
        want[d, s] += int(epochs[s]) + (draw < epochs[s] - int(epochs[s]))
    assert got.columns == odd.columns and Counter((r["doc_id"], r["source"]) for r in got.collect()) == +want
    assert mixing.sample(none, mixing.plan(none, mixing.tempered(0.7), 1.0, 4.0), 7).count() == 0
    same(queries.op3_source_mixing(spark, sf_dir), con, sql.source_mixing(**queries.MIX))


# 4 substring dedup


def brute_intervals(found, min_words):
    words = [(d, WORD.findall((t or "").lower())) for d, t in found if d is not None]
    holders = defaultdict(set)
    for d, w in words:
        for i in range(len(w) - min_words + 1):
            holders[tuple(w[i : i + min_words])].add(d)
    marks = defaultdict(set)
    for d, w in words:
        marks[d] |= {i for i in range(len(w) - min_words + 1) if len(holders[tuple(w[i : i + min_words])]) > 1}
    out = []
    for d, starts in marks.items():
        lo = hi = None
        for i in sorted(starts):
            if lo is not None and i <= hi:
                hi = i + min_words
            else:
                if lo is not None:
                    out.append((d, lo, hi))
                lo, hi = i, i + min_words
        if lo is not None:
            out.append((d, lo, hi))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_words", "vocabulary", "anchor"), [(5, 2, 3), (8, 1, 8), (12, 40, 8)])
def test_substring_dedup(spark, min_words, vocabulary, anchor):
    r = random.Random(min_words)
    texts = noise(11, 40, vocabulary)
    shared = "once upon a time there was a very long passage of some words that goes on and on"
    texts += [f"{a} {shared} {b}" for a, b in zip(noise(12, 6), noise(13, 6))] + [None, "", shared, "only here " * 20]
    found = list(enumerate(texts)) + [(3, r.choice(texts)), (None, shared)]
    got = substring_dedup.repeated(docs_of(spark, [(d, t, None, None, None) for d, t in found]), min_words, anchor)
    assert rows(got) == brute_intervals(found, min_words)


def test_substring_dedup_of_one_passage_everywhere(spark):
    """One passage in all documents, in several tasks, and one of two copies; equal segments are told by document."""
    shared = " ".join(f"p{i}" for i in range(30))
    texts = [f"{a} {shared} {b}" for a, b in zip(noise(21, 150), noise(22, 150))] + [shared] * 60
    found = list(enumerate(texts)) + [(3, shared)]
    df = docs_of(spark, [(d, t, None, None, None) for d, t in found]).repartition(7)
    assert rows(substring_dedup.repeated(df, 12, 8)) == brute_intervals(found, 12)


def test_substring_dedup_sql(spark, sf_dir, con, odd, none):
    same(queries.op4_substring_dedup(spark, sf_dir), con, sql.substring_dedup())
    assert rows(substring_dedup.repeated(odd)) == [(4, 0, 90), (5, 0, 90)] and substring_dedup.repeated(none).count() == 0


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    text = r.integers(0, 21, 3000)
    m = substring_dedup.WaveletMatrix(text, 20)
    symbol, at = r.integers(0, 21, 200), r.integers(0, 3001, 200)
    zero = np.zeros(200, np.int64)
    lo, hi = m.rank(symbol, zero, at, zero)
    assert (hi - lo == [np.count_nonzero(text[:a] == s) for s, a in zip(symbol, at)]).all()
    text = np.append(r.integers(1, 4, 200), 0)
    assert substring_dedup.suffix_array(text).tolist() == sorted(range(201), key=lambda i: text[i:].tolist())


# 5 language identification


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, s=language_id.Settings(train_docs=300, held_out=100)).toPandas()
    assert len(got) == docs.count() and (got.label == got.predicted).mean() > 0.95
    sure = got[got.confidence > 0.9]
    assert (sure.label == sure.predicted).mean() >= (got.label == got.predicted).mean() and got.confidence.between(0, 1).all()
    found = {(r["doc_id"], r["label"]): r for r in language_id.identify(odd).collect()}
    assert len(found) == len({(d, x) for d, _, x, *_ in ODD}) and found[2, "en"]["predicted"] is None and found[2, "en"]["confidence"] == 0 and found[5, "de"]["predicted"]
    assert language_id.identify(none).count() == 0
    assert {r["predicted"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


def test_language_model_is_sparse():
    r = random.Random(2)
    data = [("".join(r.choice("abcd" if k else "wxyz") for _ in range(30)), "ab"[k]) for k in (i % 2 for i in range(80))]
    s = language_id.Settings(bits=12)
    model = language_id.train(data, data[:20], np.ones(1 << 12), s)
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    logits, _ = language_id.score_texts(pa.array([t for t, _ in data]), model, 12)
    assert [model.languages[i] for i in logits.argmax(axis=1)] == [x for _, x in data]


def plain_grams(text, bits):
    """Hashed n-grams in plain integers, counted."""
    mask, out = 2**64 - 1, Counter()
    codes = []
    for ch in text.lower():
        code = 0
        for b in ch.encode():
            code = code << 8 | b
        code = (code + 1) * 0x9E3779B97F4A7C15 & mask
        codes.append(code ^ code >> 29)
    for n in language_id.LENGTHS:
        for i in range(len(codes) - n + 1):
            run = codes[i]
            for c in codes[i + 1 : i + n]:
                run = run * 0xD6E8FEB86659FD93 + c & mask
            out[((run + n) * 0xFF51AFD7ED558CCD & mask) >> 64 - bits] += 1
    return out


def test_language_model_against_brute_force(spark):
    """Document frequencies, weights after every coordinate's own steps, and scores, in plain Python."""
    r, s = random.Random(3), language_id.Settings(bits=9, epochs=2)
    data = [("".join(r.choice(("abc \u00e9", "cde\u00fc ", "ab\u65e5\u672cf")[k]) for _ in range(r.randrange(1, 25))), "xyz"[k]) for k in (i % 3 for i in range(45))]
    idf = language_id.inverse_frequencies(docs_of(spark, [(i, t, lang, None, None) for i, (t, lang) in enumerate(data)]), s.bits)
    grams = [plain_grams(t, s.bits) for t, _ in data]
    df = Counter(f for g in grams for f in g)
    assert idf.tolist() == pytest.approx([math.log((1 + len(data)) / (1 + df[f])) + 1 for f in range(1 << s.bits)], abs=1e-12)
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= s.l1:
            return 0.0
        return -(z[key] - math.copysign(s.l1, z[key])) / ((s.beta + math.sqrt(n[key])) / s.alpha + s.l2)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(data)):
            x = {f: 10 * c / sum(grams[i].values()) * idf[f] for f, c in grams[i].items()} | {"bias": 1.0}
            w = {(f, k): weight((f, k)) for f in x for k in range(3)}
            scores = [math.fsum(x[f] * w[f, k] for f in x) for k in range(3)]
            total = math.fsum(math.exp(v) for v in scores)
            for k in range(3):
                error = math.exp(scores[k]) / total - (k == "xyz".index(data[i][1]))
                for f in x:
                    g = x[f] * error
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / s.alpha * w[f, k]
                    n[f, k] += g * g
    model = language_id.train(data, [], idf, s)
    want = [[weight((f, k)) * 10 * idf[f] for k in range(3)] for f in range(1 << s.bits)]
    assert np.allclose(model.weights, want, rtol=1e-6, atol=1e-9) and np.allclose(model.bias, [weight(("bias", k)) for k in range(3)], atol=1e-9)
    logits, _ = language_id.score_texts(pa.array([t for t, _ in data]), model, s.bits)
    for g, row in zip(grams, logits):
        assert row.tolist() == pytest.approx([math.fsum(c * float(model.weights[f, k]) for f, c in g.items()) / sum(g.values()) + model.bias[k] for k in range(3)], abs=1e-9)


def test_language_ties():
    model = language_id.Trained(["a", "b"], np.zeros((1 << 8, 2), np.float32), np.zeros(2), 1.0)
    logits, _ = language_id.score_texts(pa.array(["xyz"]), model, 8)
    assert logits.argmax(axis=1).tolist() == [0]


# 6 WARC fixity


def test_warc_sql(spark, sf_dir, con):
    same(queries.op6_warc_fixity(spark, sf_dir), con, sql.warc_fixity())


def test_warc_files(spark, tmp_path):
    import gzip

    def record(i, body):
        return f"WARC/1.0\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    for side in ("a", "b"):
        (tmp_path / side).mkdir()
        for f in range(3):
            bodies = [f"body {f} {i} ".encode() * (i % 5) for i in range(40)]
            if side == "b" and f == 1:
                bodies[17] = b"?" + bodies[17][1:]
            if side == "b" and f == 2:
                bodies[30] += b"longer"
            (tmp_path / side / f"{f}.warc.gz").write_bytes(b"".join(gzip.compress(record(i, x)) for i, x in enumerate(bodies)))
    a, b = (warc_fixity.trees(warc_fixity.read_records(spark, str(tmp_path / side))) for side in "ab")
    got = [(r["record_id"], r["status"]) for r in warc_fixity.audit(a, b).collect()]
    assert sorted(got) == sorted([("urn:17", "corrupt"), ("urn:30", "corrupt"), *((f"urn:{i}", "moved") for i in range(31, 40))])
    assert warc_fixity.audit(a, a).count() == 0


def test_warc_files_of_one_name(spark, tmp_path):
    """Files are told apart by folder; empty and truncated ones, and records without a length, have defined records."""
    record = b"WARC/1.0\r\nWARC-Record-ID: <urn:1>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    for name, data in (("x/0.warc", record * 2), ("y/0.warc", record), ("y/1.warc", b""), ("y/2.warc", record[:-6]), ("y/3.warc", b"WARC/1.0\r\n\r\nrest " + record)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = warc_fixity.read_records(spark, str(tmp_path)).collect()
    n = len(record)
    assert sorted(Counter(r["file"] for r in found).values()) == [1, 1, 1, 2]
    assert sorted(len(r["bytes"]) for r in found) == sorted([n, n, n, n - 6, n + len(b"WARC/1.0\r\n\r\nrest ")])


def test_warc_odd_pages(spark):
    pages = docs_of(spark, [(None, None, None), (None, "u", "h"), (1, "u", None), (1, "u", None), (2, "", ""), (5001, "u", "x" * 100_000)], "page_id long, url string, html string")
    t = warc_fixity.trees(warc_fixity.page_records(pages))
    assert warc_fixity.audit(t, t).count() == 0
    gone = warc_fixity.trees(warc_fixity.page_records(pages.where("page_id < 5000")))
    assert sorted((r["file"], r["copy"], r["status"]) for r in warc_fixity.audit(t, gone).collect()) == [(-1, 1, "missing"), (-1, 2, "missing"), (5, 1, "missing")]
    empty = warc_fixity.trees(warc_fixity.page_records(pages.limit(0)))
    assert warc_fixity.audit(empty, empty).count() == 0 and {r["status"] for r in warc_fixity.audit(empty, t).collect()} == {"extra"}


# 7 secret scans


def found_in(text):
    return [(p.name, p.literal) for p in secret_scan.pairs(text)]


def program(r):
    """Assignments in many forms among prose and code, and the secrets that they hold, known without any lexing."""
    lines, want = [], []
    secret = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(r.randrange(16, 40)))
    for _ in range(r.randrange(1, 25)):
        name, value = r.choice(["password", "api_secret", "DB_PASSWD", "authToken", "credentials"]) + str(r.randrange(9)), secret()
        form = r.randrange(12)
        lines += [[f'{name} = "{value}"'], [f"{name}: '{value}'"], [f'"{name}": "{value}",'], [f"export {name.upper()}={value}"], [f"# {name} = '{value}'"], [f'const {name}: string = "{value}";'],
                  [f'x = "{value[:9]}"', f'y = "{value[9:]}"', f"{name} = x + y"], [f'{name} = (', f'    "{value[:8]}"', f'    "{value[8:]}"', ")"], [f"/* {name} := `{value}` */"],
                  [f'greeting_{r.randrange(9)} = "{value}"'], [f"if {name} == '{value}' and more:"], [f"they said the {name}, once, {value}"]][form]
        if form < 9:
            want.append((name.upper() if form == 3 else name, value))
        lines.append(r.choice(["", "some prose that isn't code", "for i in range(10): pass", "x[3] += f(1)", "it's", "path/*.c and 5*/2"]))
    return "\n".join(lines), want


def test_planted_secrets():
    r = random.Random(11)
    for _ in range(300):
        text, want = program(r)
        got = [(name, length, digest) for _, name, _, length, digest, _, _ in secret_scan.scan_text(text, 0.5)]
        assert sorted(got) == sorted((n, len(v), hashlib.sha256(v.encode()).hexdigest()) for n, v in want), text


@pytest.mark.parametrize("unit", ["/* ", "<!-- ", '"', '\\"', "'a ", "`", "a=`", '"""x', 'b"\\"', "x: ", "key = ("])
def test_secret_scan_is_linear(unit):
    text = unit * (300_000 // len(unit))
    at = time.process_time()
    secret_scan.scan_text(text, 0.5)
    secret_scan.lex(text)
    assert time.process_time() - at < 15  # hours if it were quadratic


def test_long_names_and_literals():
    name = "password_" + "x" * 500
    assert found_in(f'{name} = "abc123XYZ789"') == [(name, "abc123XYZ789")]
    got = found_in('key = ""\n' + 'key += "abcdefgh"\n' * 2000)
    assert len(got) == 2001 and len(got[-1][1]) == secret_scan.LONGEST


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password = "abc123XYZ789"', [("password", "abc123XYZ789")]),
        ("API_KEY: s3cr3tvalue9\n", [("API_KEY", "s3cr3tvalue9")]),
        ('{"db.password": "p@ss"}', [("db.password", "p@ss")]),
        ('a = "x1"\nb = "y2"\ntoken = a + b', [("a", "x1"), ("b", "y2"), ("token", "x1y2")]),
        ("key := `raw`; f(1)", [("key", "raw")]),
        ('t = "it\\"s"', [("t", 'it"s')]),
        ('setToken("abc")', [("setToken", "abc")]),
        ('settings["secret"] = "zz"', [("secret", "zz")]),
        ("x == 'no' and y", []),
        ("plain words only", []),
    ],
)
def test_assignments(text, want):
    assert found_in(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('/* password = "abc123XYZ789" */', [("password", "abc123XYZ789")]),
        ("<!-- api_key: s3cr3tvalue9 -->", [("api_key", "s3cr3tvalue9")]),
        ("/*key=s3cr3tvalue9*/", [("key", "s3cr3tvalue9")]),
        ('cp /data/* x\ntoken = "abc123"\n*/5 * * * * run', [("token", "abc123")]),
        ('password: str = "abc123"', [("password", "abc123")]),
        ('const apiKey: string = "abc123"', [("apiKey", "abc123")]),
        ('key: Optional[dict[str, int]] = "abc123"', [("key", "abc123")]),
        ('let key: &\'static str = "abc123";', [("key", "abc123")]),
        ('if user: token = "abc123"', [("token", "abc123")]),
        ('var token string = "abc123"', [("token", "abc123")]),
        ('key = (\n    "abc"\n    "def"\n)', [("key", "abcdef")]),
        ('key =\n    "abc123"', [("key", "abc123")]),
        ('key = "abc" +\n    "def"', [("key", "abcdef")]),
        ('tokens = ["abc123", "def456"]', [("tokens", "abc123"), ("tokens", "def456")]),
        ('{"auth": {"user": "bob", "password": "p@ss"}}', [("user", "bob"), ("password", "p@ss")]),
    ],
)
def test_assignments_in_all_forms(text, want):
    assert found_in(text) == want and secret_scan._SIGN.search(text)


def test_placeholders_are_words():
    real = [("password", "key-3ax6xnjp29jd6fds4gc373sgvjxteol0"), ("password", "secret_aQzRvTbXkLmWnPoYsUcJdHfGeIqBwVxKtZyMrNlOpSu"), ("password", "MySecr3tPassw0rd99"), ("passphrase", "correct horse battery staple under water"), ("access", "Zx81kQ90mW3vB7tt"), ("pin", "Zx81kQ90mW3vB7tt")]
    assert all(secret_scan.score(n, v) >= 0.5 for n, v in real)
    assert not any(secret_scan.score("password", v) for v in ("changeme", "your-api-key-here", "YOUR_PASSWORD_HERE", "my secret password", "MySecretPassword", "example_token", "a note of more than five words"))


def test_secret_scan(spark, odd, none):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [f'note = "{key}"', 'password = "changeme"', 'part1 = "Zx81kQ90"\npart2 = "mW3vB7tt"\nclient_secret = part1 + part2', 'greeting = "Zx81kQ90mW3vB7tt"', "The password: is kept elsewhere, he said.", 'test_password_label = "Zx81kQ90mW3vB7tt"']
    got = {r["doc_id"]: r for r in secret_scan.scan(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert set(got) == {0, 2} and got[0]["score"] == 1.0 and got[2]["propagated"] and got[2]["sha256"] == hashlib.sha256(b"Zx81kQ90mW3vB7tt").hexdigest()
    assert [r["doc_id"] for r in secret_scan.scan(odd).collect()] == [9] and secret_scan.scan(none).count() == 0


# 8 SentencePiece

MODEL = queries.SENTENCEPIECE_MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model here")


@needs_model
def test_sentencepiece(spark, odd, none, docs):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (odd, docs):
        text = {(r["doc_id"], r["text"]) for r in df.collect()}
        by = defaultdict(set)
        for d, t in text:
            by[d].add(None if t is None else tuple(whole.encode(t)))
        got = sentencepiece_codec.encode(df, MODEL)
        for r in got.collect():
            assert (None if r["token_ids"] is None else tuple(r["token_ids"])) in by[r["doc_id"]]
            assert r["parity"] in (True, None) and r["n_tokens"] == (None if r["token_ids"] is None else len(r["token_ids"]))
        assert got.count() == df.count()
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, MODEL), MODEL).collect()}
    assert all(back[r["doc_id"]] == whole.decode(whole.encode(r["text"])) for r in docs.collect())
    assert sentencepiece_codec.encode(none, MODEL).count() == 0


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def written_model(pieces, kind, byte_fallback, charsmap=b"", dummy_prefix=1, squeeze=1):
    """A model file made of given pieces; nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * byte_fallback + pieces
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, t)) for p, s, t in rows)
    out += field(2, field(3, kind) + field(4, len(rows)) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, 2**64 - 1))
    return out + field(3, field(1, b"identity") + field(2, charsmap) + field(3, dummy_prefix) + field(4, squeeze) + field(5, 1))


def unigram_pieces(seed):
    r = random.Random(seed)
    words = {"\u2581", *"abcdehilnorstu", *(("\u2581" if r.random() < 0.5 else "") + "".join(r.choice("abcdehilnorstu") for _ in range(r.randrange(1, 6))) for _ in range(300)), "\u00e9", "\u65e5\u672c"}
    return [(w, -r.uniform(2, 12), 1) for w in sorted(words)]


def samples(seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdehilnorstu    xyz\u00e9\u65e5\u672c\U0001f600,.\n\t") for _ in range(r.randrange(0, 60))) for _ in range(250)] + ["", " ", "  ", "a" * 5000, "\u2581", " a  b "]


@pytest.mark.parametrize(("byte_fallback", "dummy_prefix", "squeeze"), [(False, 1, 1), (True, 1, 1), (True, 0, 0), (False, 1, 0)])
def test_unigram_models(tmp_path, byte_fallback, dummy_prefix, squeeze):
    """Ids of written unigram models, with and without byte fallback, against the sentencepiece library."""
    import sentencepiece

    data = written_model(unigram_pieces(1), 1, byte_fallback, dummy_prefix=dummy_prefix, squeeze=squeeze)
    (tmp_path / "m.model").write_bytes(data)
    whole, codec = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), sentencepiece_codec.WordCodec(sentencepiece_codec.parse_model(data))
    texts = samples(5)
    ids, at, fine, _ = codec.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(t), t
    assert fine[texts.index("")]


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_models_with_a_character_map(tmp_path, byte_fallback):
    """A compiled NFKC map, as the library carries it, in a written model."""
    import sentencepiece

    charsmap = sentencepiece_codec.parse_model(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).charsmap
    data = written_model(unigram_pieces(1), 1, byte_fallback, charsmap=charsmap)
    (tmp_path / "m.model").write_bytes(data)
    whole = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    codec = sentencepiece_codec.WordCodec(sentencepiece_codec.parse_model(data), library=whole)
    texts = samples(5) + ["\ufb01ne \uff21\uff22\uff11", "e\u0301te\u0301 \u2163", "x\u200by\u3000z\u00a0 w", "\u2460\r\n\u2461"]
    ids, at, _, equal = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(t) for t in texts] and equal.all()


def test_parity_is_reported(spark, tmp_path):
    """Texts that the pieces can't spell, and ids beyond the vocabulary."""
    data = written_model(unigram_pieces(2), 1, False)
    (tmp_path / "m.model").write_bytes(data)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(docs_of(spark, [(1, "a b c", None, None, None), (2, "a \U0001f600", None, None, None)]), str(tmp_path / "m.model")).collect()}
    assert got[1]["round_trip"] and not got[2]["round_trip"]
    ids = spark.createDataFrame([(1, [5, 10**6, -1, 6]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(ids, str(tmp_path / "m.model")).collect()}
    assert back[2] is None and back[3] == "" and isinstance(back[1], str)


# 9 HTML extraction


def page(title, paragraphs, extra=""):
    return f"<html><head><title>{title}</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li>Home<li>About</ul></nav><h1>{title}</h1>{extra}" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div>All rights reserved</div><footer>Imprint</footer></body></html>"


def test_wrappers(spark, none):
    html = [page("One", ["first <b>bold</b> &amp; more"]), page("Two", ["a", "b", "c"]), page("Three", [], "<h2>Sub</h2>"), page("Four", ["d"], "<h2>Other</h2>")]
    rows_ = [(i, f"https://User@Shop.example:80/p{i}", h) for i, h in enumerate(html)] + [(9, "https://shop.example/p9", html[3]), (10, None, "<p>alone</p>"), (11, "https://x.example/", None), (None, "https://x.example/", ""), (12, "https://y.example/", "no markup " * 20_000)]
    df = docs_of(spark, rows_, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in wrappers.extract(df).collect()}
    assert got[0]["text"] == "One\nOne\nfirst bold & more" and got[1]["text"] == "Two\nTwo\na\nb\nc" and got[2]["text"] == "Three\nThree\nSub" and got[9]["text"] == got[3]["text"] == "Four\nFour\nOther\nd"
    assert got[10]["text"] == "alone" and got[11]["n_slots"] == 0 and got[None]["text"] == "" and got[12]["n_slots"] == 1 and got[0]["host"] == "shop.example"
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_of_copies(spark):
    """Copies don't make a template, nor do two of many pages."""
    one = page("T", ["alpha beta"])
    rare = [page(f"t{i}", [f"p{i}"], "<blockquote>Seldom</blockquote>" if i < 2 else "") for i in range(40)]
    rows = [(i, "http://copies.org/", one) for i in range(3)] + [(100 + i, "http://rare.org/", h) for i, h in enumerate(rare)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(docs_of(spark, rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(3)} == {"T\nT\nalpha beta\nAll rights reserved"}
    assert got[100] == "t0\nt0\nSeldom\np0" and got[139] == "t39\nt39\np39"


@pytest.mark.parametrize(
    ("entries", "kept"),
    [
        ("body form # /form /body", [True]),
        ("body nav # h1 # /h1 p # /p /body", [False, True, True]),
        ("body div aside # /div p # /p /body", [False, True]),
        ("body nav section # /section # /nav p # /p /body", [False, False, True]),
        ("body nav # /nav footer # (article # /article)+ # /body", [False, False, True]),
    ],
)
def test_furniture(entries, kept):
    entries = re.findall(r"\(.*?\)\+|\S+", entries)
    assert [not f for e, f in zip(entries, wrappers.furniture(entries)) if e == "#"] == kept


def brute_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def matches(wrapper, stream):
    """Whether a wrapper's expression, read as a regular expression over tokens, gives all of a stream."""
    expression = re.sub(r"[^()+? ]+", lambda m: "(?:" + re.escape(m[0]) + " )", str(wrapper)).replace(" )", "\0").replace(" ", "").replace("\0", " )").replace("+?", "*")
    flat = stream.replace("\n", " ")
    while "(" in flat:
        flat = re.sub(r"\(([^()]*)\)\+", r"\1", flat)
    return re.fullmatch(expression, flat + " ") is not None


def test_alignment_against_brute_force():
    """The subsequence is a longest one, and the wrapper of random streams matches each of them."""
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abcde#") for _ in range(r.randrange(0, 25))] for _ in range(2))
        got = wrappers._longest(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got)) and len(got) == brute_longest(a, b)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))
    for _ in range(400):
        w, streams = wrappers.Wrapper(), []
        for _ in range(r.randrange(1, 6)):
            row = [t for _ in range(r.randrange(1, 5)) for t in r.choice([["h1", "#", "/h1"], ["p", "#", "/p"], ["ul", *["li", "#", "/li"] * r.randrange(1, 4), "/ul"], ["hr"]])]
            streams.append("\n".join(k for k, _ in wrappers.fold(row)))
            w.align(streams[-1].split("\n"))
        assert all(matches(w, s) for s in streams), (str(w), streams)


def test_rows_of_any_length_fold():
    for cells in (3, 17, 60):
        row = ["tr", *(x for i in range(cells) for x in (f"t{i}", "#", f"/t{i}")), "/tr"]
        streams = {"\n".join(k for k, _ in wrappers.fold(["table", *row * times, "/table"])) for times in (2, 3, 5)}
        assert len(streams) == 1 and sum(n for _, n in wrappers.fold([*row * 4])) == 4 * len(row)


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!-- ", "<!", "<script ", "<p>", "<a '\"", "<", '<td a="<', "<p>x</p><b>"])
def test_tokens_are_linear(unit):
    at = time.process_time()
    found = wrappers.tokens(unit * (1_000_000 // len(unit)))
    assert time.process_time() - at < 15 and len(found) < 400_000


def test_tokens():
    page_ = "a<b>c</b> < d <p class='x>y' id=\"<q>\">e<!-- <p> --><script>if (a<b) '</p>'</script >f<BR/>g<!doctype html><i"
    assert wrappers.tokens(page_) == [("#", "ac < d"), ("p", ""), ("#", "ef g<i")]


def test_alignment():
    w = wrappers.Wrapper()
    for s in (["h1", "#", "/h1", "p", "#", "/p"], ["h1", "#", "/h1", "h2", "#", "/h2", "p", "#", "/p"], ["h1", "#", "/h1"]):
        w.align(s)
    assert str(w) == "h1 # /h1 h2? #? /h2? p? #? /p?"
    assert [k for k, _ in wrappers.fold(["ul", "li", "#", "/li", "li", "#", "/li", "/ul"])] == ["ul", "(li # /li)+", "/ul"]
