"""Reproducible positive samples, injected classification, category shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pitrank.contracts import SEALED_FROM, ContractError
from pitrank.functions.hashing import uniform_key
from pitrank.functions.scalars import wilson_bounds

# The three drivers of a top-k appearance.
CATEGORIES = ("scheduled_catalyst", "carryover", "unscheduled")


def sample_positives(labels: DataFrame, n: int = 200, seed: int = 0, sealed_from: str = SEALED_FROM) -> DataFrame:
    """``n`` positives before the sealed period, without replacement, same rows for the same seed."""
    open_rows = labels.where((F.col("label") == 1) & (F.col("trade_date") < F.lit(sealed_from).cast("date")))
    keyed = open_rows.withColumn("_k", uniform_key(seed, "trade_date", "ticker"))
    return keyed.orderBy("_k", "trade_date", "ticker").limit(n).drop("_k")


def classify(samples: DataFrame, classifier: Callable[[pd.DataFrame], Sequence[str]],
             categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Append ``category`` from a caller-supplied batch classifier; an unknown category stops the query."""
    allowed = tuple(categories)

    @F.pandas_udf("string")
    def apply(rows: pd.DataFrame) -> pd.Series:
        got = pd.Series(list(classifier(rows)), dtype="object")
        bad = sorted(set(got) - set(allowed), key=str)
        if bad or len(got) != len(rows):
            raise ContractError(f"classifier returned {bad}, allowed {allowed}")
        return got

    return samples.withColumn("category", apply(F.struct(*[F.col(c) for c in samples.columns])))


def category_share(classified: DataFrame, categories: Sequence[str] = CATEGORIES, confidence: float = 0.95) -> DataFrame:
    """Count, share and Wilson interval of every category, absent ones included."""
    counts = classified.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col("category") == c, 1)).alias(f"c{i}") for i, c in enumerate(categories)],
    )
    listed = counts.select(
        "n",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("category"), F.col(f"c{i}").alias("count")) for i, c in enumerate(categories)
        ])).alias("e"),
    ).select("e.category", "e.count", "n")
    low, high = wilson_bounds(F.col("count"), F.col("n"), confidence)
    share = F.col("count") / F.when(F.col("n") > 0, F.col("n"))
    return listed.select("category", "count", "n", share.alias("share"), low.alias("ci_low"), high.alias("ci_high"))
