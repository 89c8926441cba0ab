"""Mixing sources to target weights.

plan() fills a budget of characters by weight (capped water-filling): each source gets its weight's share; a
source whose share is more than max_epochs times its size is clamped there, and what it can't take is spread
over the others in proportion to their weights, until no source is over its cap or all are at it. sample()
then repeats each document whole as often as its source's epochs say, and once more with the probability of
the rest, decided by a seeded hash of doc_id.

Defined results: a null source is a source of its own. Null and empty texts have no characters but are sampled
with their source; a source without any characters gets 1 epoch. A source without a weight, or whose weight
is null or not above 0, gets no epochs. Weights of sources that aren't there are ignored, the rest rescaled.
A null doc_id is hashed as "". Rows of one doc_id are sampled alike. Columns other than doc_id, text and
source are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.llm.storage import fresh, limited_broadcast, stored


def water_fill(size: pd.Series, weight: pd.Series, budget: float, max_epochs: float) -> pd.Series:
    """Characters that each source gives."""
    weight = weight.where(size > 0, 0.0).clip(lower=0).fillna(0.0)
    cap, out = max_epochs * size, pd.Series(0.0, index=size.index)
    open_ = weight > 0
    left = float(min(budget, cap[open_].sum()))
    while open_.any() and left > 0:
        share = left * weight[open_] / weight[open_].sum()
        over = share[share >= cap[open_]].index
        if not len(over):
            out[share.index] = share
            break
        out[over] = cap[over]
        left -= float(cap[over].sum())
        open_[over] = False
    return out


def tempered(alpha: float) -> Column:
    """Weights that grow with a source's size to the power alpha (1: as it is, 0: all alike)."""
    return F.pow(F.col("n_chars").cast("double"), F.lit(alpha))


def plan(docs: DataFrame, weight: Column, budget_ratio: float, max_epochs: float) -> DataFrame:
    """source, n_docs, n_chars, weight, epochs of each source.

    weight: a column over source, n_docs and n_chars. budget_ratio: the budget as a multiple of all characters.
    The table of sources is one small row each, so one task fills it.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars")).withColumn("weight", weight.cast("double"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if whole:
            t = pd.concat(whole, ignore_index=True).sort_values("source", na_position="first", ignore_index=True)
            given = water_fill(t.n_chars, t.weight, budget_ratio * float(t.n_chars.sum()), max_epochs)
            t["epochs"] = (given / t.n_chars.where(t.n_chars > 0)).fillna(1.0)
            yield t

    return sizes.repartition(1).mapInPandas(fill, "source string, n_docs long, n_chars long, weight double, epochs double")


def _draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 sum."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)


def sample(docs: DataFrame, planned: DataFrame, seed: int, number: str | None = None) -> DataFrame:
    """The rows of docs, repeated by their source's epochs; number: a column that counts the repetitions from 1."""
    name, share, count, one = fresh(docs, "planned_source", "epochs", "times", number or "number")
    epochs = limited_broadcast(stored(planned.select(F.col("source").alias(name), F.col("epochs").alias(share)), "mix"))
    joined = docs.join(epochs, docs["source"].eqNullSafe(epochs[name]), "left")
    whole = F.floor(share).cast("int")
    times = whole + (_draw(docs["doc_id"], seed) < F.col(share) - whole).cast("int")
    out = joined.withColumn(count, F.coalesce(times, F.lit(0))).where(F.col(count) > 0)
    out = out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(count))).alias(one))
    return out if number else out.select(*docs.columns)
