"""Leakage gates.  Each returns the offending rows; ``assert_empty`` turns them into an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitrank import contracts as C
from pitrank.contracts import LeakageError
from pitrank.functions.clock import decision_time
from pitrank.functions.hashing import uniform_key
from pitrank.functions.scalars import random_guess_tolerance
from pitrank.operators.ranks import GRAIN, average_rank, positions, top_k, with_rank_parts_of
from pitrank.session import stored

LABEL_COLUMNS = ("return_t", "rank", "label")


def assert_empty(violations: DataFrame, what: str, show: int = 20) -> None:
    """Raise with a few examples if any violation exists (stops at the first rows found)."""
    rows = violations.limit(show).collect()
    if rows:
        raise LeakageError(f"{what}: {[r.asDict() for r in rows]}")


# --- L1: knowable at decision time ------------------------------------------------------


def decision_time_violations(df: DataFrame, task: str, date_col: str = "trade_date") -> DataFrame:
    """Rows stamped after the decision instant of their own date, or not stamped at all."""
    if "as_of" not in df.columns:
        raise LeakageError("frame has no as_of column")
    limit = decision_time(task, date_col)
    ids = [c for c in ("ticker", date_col) if c in df.columns]
    return df.where(F.coalesce(F.col("as_of") > limit, F.lit(True))).select(*ids, "as_of", limit.alias("decision_time"))


def guarded(df: DataFrame, task: str, date_col: str = "trade_date") -> DataFrame:
    """The gate inside the projection: raises while rows stream, costs no extra pass.

    A row without a stamp is refused like a late one, as in ``quarantine_split``.
    """
    late = F.coalesce(F.col("as_of") > decision_time(task, date_col), F.lit(True))
    message = F.concat(
        F.lit(f"row not knowable at {task} decision time: "), F.coalesce(F.col(date_col).cast("string"), F.lit("?"))
    )
    checked = F.when(late, F.raise_error(message).cast("timestamp_ntz")).otherwise(F.col("as_of"))
    return df.withColumn("as_of", checked)


# --- L2 / L3: back-adjusted prices ------------------------------------------------------


def adjusted_suspects(bars: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Bars that predate an action of their ticker announced after the bar was written.

    Some action with ``ex_date > trade_date`` and ``action.as_of > bar.as_of`` exists
    exactly when the largest as_of among the later actions exceeds the bar's, so one
    running maximum per ticker answers it; bar-action pairs are never formed.
    Without actions only the weak rule ``as_of < trade_date`` is checked.
    """
    if actions is None:
        weak = F.col("as_of") < F.col("trade_date").cast("timestamp_ntz")
        return bars.where(weak).select("ticker", "trade_date", "as_of")
    later = actions.groupBy("ticker", F.col("ex_date").alias("d")).agg(F.max("as_of").alias("action_as_of"))
    rows = bars.select("ticker", F.col("trade_date").alias("d"), "as_of", F.lit(True).alias("bar")).unionByName(
        later, allowMissingColumns=True
    )
    # Newest first; RANGE 1 PRECEDING on the negated day number: strictly later ex-dates only, in a growing frame.
    w = (
        W.partitionBy("ticker")
        .orderBy(-F.datediff("d", F.lit("1970-01-01").cast("date")))
        .rangeBetween(W.unboundedPreceding, -1)
    )
    seen = rows.withColumn("latest_action_as_of", F.max("action_as_of").over(w))
    return seen.where("bar and latest_action_as_of > as_of").select(
        "ticker", F.col("d").alias("trade_date"), "as_of", "latest_action_as_of"
    )


def unadjusted_violations(bars: DataFrame, actions: DataFrame, flat_band: float = 0.10) -> DataFrame:
    """Splits across which the close does not jump, the mark of a back-adjusted series.

    Actions without a bar on both sides, or with a non-positive close, cannot be
    judged and are skipped.
    """
    splits = actions.where(
        F.col("action_type").isin(*C.SPLIT_ACTIONS)
        & (F.col("ratio") > 0)
        & (F.abs(F.col("ratio") - 1.0) > 1e-9 * F.greatest(F.abs("ratio"), F.lit(1.0)))
    ).select("ticker", "ex_date", "ratio")
    asked = splits.select("ticker", F.col("ex_date").alias("d")).distinct().withColumn("asked", F.lit(True))
    closes = bars.where(F.col("close").isNotNull()).select("ticker", F.col("trade_date").alias("d"), "close")
    timeline = closes.join(asked, ["ticker", "d"], "full")
    by_day = W.partitionBy("ticker").orderBy("d")
    newest_first = W.partitionBy("ticker").orderBy(F.desc("d"))
    around = timeline.select(
        "ticker",
        F.col("d").alias("ex_date"),
        "asked",
        F.last("close", ignorenulls=True).over(by_day.rowsBetween(W.unboundedPreceding, -1)).alias("last_before"),
        F.last("close", ignorenulls=True).over(newest_first.rowsBetween(W.unboundedPreceding, 0)).alias("first_after"),
    ).where("asked and last_before > 0 and first_after > 0")
    observed = F.col("first_after") / F.col("last_before")
    return (
        splits.join(around, ["ticker", "ex_date"])
        .where(F.abs(observed - 1.0) <= flat_band)
        .select(
            "ticker",
            "ex_date",
            F.col("ratio").alias("split_ratio"),
            (1.0 / F.col("ratio")).alias("expected_ratio"),
            observed.alias("observed_ratio"),
        )
    )


# --- L4: a label inside its own features ------------------------------------------------


def _feature_columns(features: DataFrame) -> list[str]:
    forbidden = [c for c in LABEL_COLUMNS if c in features.columns]
    if forbidden:
        raise LeakageError(f"features carry label columns {forbidden}")
    if not {"trade_date", "ticker"} <= set(features.columns):
        raise LeakageError("features need trade_date and ticker")
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return [
        n for n, t in features.dtypes
        if n not in ("trade_date", "ticker", "as_of") and (t in numeric or t.startswith("decimal"))
    ]


def align(features: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Features with the same-day label columns, inner on (date, ticker); without ``labels`` they already carry them."""
    if labels is None:
        return features
    return features.join(labels.select("trade_date", "ticker", *LABEL_COLUMNS), ["trade_date", "ticker"])


def _close_enough(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    both_null = a.isNull() & b.isNull()
    return both_null | F.coalesce(near, F.lit(False))


def _compared_columns(features: DataFrame, labels: DataFrame | None) -> list[str]:
    return _feature_columns(features if labels is not None else features.drop(*LABEL_COLUMNS))


def identity_leaks(features: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Feature columns equal to a label column on every row: one wide aggregate, no unpivot."""
    cols = _compared_columns(features, labels)
    joined = align(features, labels)
    pairs = [(f, y) for f in cols for y in LABEL_COLUMNS]
    same = [
        F.min(_close_enough(F.col(f).cast("double"), F.col(y).cast("double")).cast("int")).alias(f"p{i}")
        for i, (f, y) in enumerate(pairs)
    ]
    verdict = joined.agg(*same)
    out = F.explode(
        F.array(*[
            F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label_col"), F.col(f"p{i}").alias("same"))
            for i, (f, y) in enumerate(pairs)
        ])
    )
    return verdict.select(out.alias("v")).select("v.feature", "v.label_col", F.coalesce(F.col("v.same") == 1, F.lit(False)).alias("identical"))


def _long(joined: DataFrame, cols: Sequence[str], ys: Sequence[str]) -> DataFrame:
    complete = joined
    for y in ys:
        complete = complete.where(F.col(y).isNotNull())
    return complete.select(
        "trade_date",
        *[F.col(y).cast("double").alias(y) for y in ys],
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
        ).alias("f"),
    ).select("trade_date", *ys, "f.feature", "f.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


#: A day with more rows than this is ranked in slices by Spark, all others at once in the task that holds the day.
WIDE_DAY = 1_000_000
_DAILY = "trade_date date, feature string, n long, label_col string, varies boolean, pearson double, spearman double"


def daily_correlations(
    features: DataFrame, labels: DataFrame | None, complete_labels: bool | None = None, wide_day: int = WIDE_DAY
) -> DataFrame:
    """Pearson and Spearman of every feature with every label column, per day.

    Label columns are ranked among the rows that have the feature.  With complete
    labels a pair uses the rows where the feature and all label columns are present;
    when some label column has nulls each pair uses exactly the rows where both sides
    are present.  The aligned rows move once, whole, to their day; days beyond
    ``wide_day`` rows are left out there, then unpivoted and ranked in slices.
    """
    cols = _compared_columns(features, labels)
    joined = align(features, labels).select("trade_date", *[F.col(c).cast("double").alias(c) for c in [*cols, *LABEL_COLUMNS]])
    if complete_labels is None:
        joined = stored(joined)
        probe = joined.agg(*[F.count(F.when(F.col(y).isNull(), 1)).alias(y) for y in LABEL_COLUMNS]).first()
        complete_labels = not any(probe)
    groups = [LABEL_COLUMNS] if complete_labels else [(y,) for y in LABEL_COLUMNS]

    def one_day(pdf: pd.DataFrame) -> pd.DataFrame:
        day, names = pdf["trade_date"].iloc[0], ["trade_date", "feature", "n", "label_col", "varies", "pearson", "spearman"]
        if pdf["_rows"].iloc[0] > wide_day:
            return pd.DataFrame([(day, *[None] * 6)], columns=names)
        values = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in [*cols, *LABEL_COLUMNS]}
        return pd.DataFrame([(day, *r) for ys in groups for r in _day_correlations(values, cols, ys)], columns=names)

    # All rows of a day are peers here, so the running count is that of the day; a day that is too wide keeps one row.
    day = W.partitionBy("trade_date").orderBy("trade_date")
    counted = joined.select("*", F.count(F.lit(1)).over(day).alias("_rows"), F.row_number().over(day).alias("_row"))
    kept = counted.where((F.col("_rows") <= wide_day) | (F.col("_row") == 1)).drop("_row")
    daily = stored(kept.groupBy("trade_date").applyInPandas(one_day, _DAILY))
    out = daily.where(F.col("feature").isNotNull())
    # At most one row a calendar day; hardly ever any.
    wide_days = [r[0] for r in daily.where(F.col("feature").isNull()).select("trade_date").collect()]
    if wide_days:
        for ys in groups:
            out = out.unionByName(_correlations(_long(joined.where(F.col("trade_date").isin(wide_days)), cols, ys), ys))
    return out


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, ties = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(ties) - (ties - 1) / 2.0)[at]


def _rho(a: np.ndarray, b: np.ndarray) -> float | None:
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).mean() * (b * b).mean())
    return float((a * b).mean() / scale) if scale > 0 else None


def _day_correlations(values: dict[str, np.ndarray], cols: Sequence[str], ys: Sequence[str]) -> Iterator[tuple]:
    """(feature, n, label column, varies, pearson, spearman) of one day's columns; missing is NaN."""
    labelled = ~np.any([np.isnan(values[y]) for y in ys], axis=0)
    ranks_of_all: dict[str, np.ndarray] = {}
    for c in cols:
        there = labelled & ~np.isnan(values[c])
        n = int(there.sum())
        if n == 0:
            continue
        x = values[c][there]
        rank_x = _average_ranks(x)
        whole = n == int(labelled.sum())
        for name in ys:
            y = values[name][there]
            if whole and name in ranks_of_all:
                rank_y = ranks_of_all[name]
            else:
                rank_y = _average_ranks(y)
                if whole:
                    ranks_of_all[name] = rank_y
            yield c, n, name, bool(x.max() > x.min() and y.max() > y.min()), _rho(x, y), _rho(rank_x, rank_y)


def _correlations(long: DataFrame, ys: Sequence[str]) -> DataFrame:
    keys = ["trade_date", "feature"]
    values = ["x", *ys]
    ranked = with_rank_parts_of(long, keys, values, grain=GRAIN, made=lambda c: {f"_r_{c}": average_rank(c)})
    aggs = [F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
            F.var_pop("x").alias("vx"), F.var_pop("_r_x").alias("vrx")]
    for y in ys:
        aggs += [
            (F.max(y) > F.min(y)).alias(f"{y}_varies"),
            F.var_pop(y).alias(f"{y}_v"),
            F.covar_pop("x", y).alias(f"{y}_c"),
            F.var_pop(f"_r_{y}").alias(f"{y}_rv"),
            F.covar_pop("_r_x", f"_r_{y}").alias(f"{y}_rc"),
        ]
    daily = ranked.groupBy(*keys).agg(*aggs)

    def rho(c: str, vx: str, vy: str) -> Column:
        scale = F.sqrt(F.col(vx) * F.col(vy))
        return F.col(c) / F.when(scale > 0, scale)

    expanded = F.explode(
        F.array(*[
            F.struct(
                F.lit(y).alias("label_col"),
                (F.col(f"{y}_varies") & (F.col("hi") > F.col("lo"))).alias("varies"),
                rho(f"{y}_c", "vx", f"{y}_v").alias("pearson"),
                rho(f"{y}_rc", "vrx", f"{y}_rv").alias("spearman"),
            )
            for y in ys
        ])
    )
    return daily.select(*keys, "n", expanded.alias("e")).select(*keys, "n", "e.*")


def correlation_leaks(
    features: DataFrame,
    labels: DataFrame | None,
    rho_threshold: float = 0.99,
    min_group_size: int = 5,
    min_hit_fraction: float = 0.5,
    complete_labels: bool | None = None,
) -> DataFrame:
    """Verdict per feature and label column: near-perfect correlation on enough evaluable days."""
    daily = daily_correlations(features, labels, complete_labels).where(
        (F.col("n") >= min_group_size) & F.col("varies")
    )
    worst = F.greatest(F.abs("pearson"), F.abs("spearman"))
    return (
        daily.groupBy("feature", "label_col")
        .agg(
            F.count(F.lit(1)).alias("evaluable_days"),
            F.count(F.when(worst >= rho_threshold, 1)).alias("hit_days"),
        )
        .withColumn("leaks", F.col("hit_days") >= F.lit(min_hit_fraction) * F.col("evaluable_days"))
    )


def assert_self_exclusion(features: DataFrame, labels: DataFrame, **how) -> None:
    """Raise if a feature equals a label column of its own day or follows it closely."""
    assert_empty(identity_leaks(features, labels).where("identical"), "feature equals a same-day label column")
    assert_empty(correlation_leaks(features, labels, **how).where("leaks"), "feature disguises a same-day label")


# --- L5 / L6: shuffled labels -----------------------------------------------------------


def shuffle_labels(labels: DataFrame, seed: int = 0) -> DataFrame:
    """Permute (rank, return_t, label) among the tickers of each day.

    Row i in ticker order receives the values of row i in hash order: a bijection
    within the day, independent of partitioning.  Both sides number the labels, which
    are therefore written once.
    """
    return shuffled_trials(stored(labels), [seed]).select(*labels.columns)


def shuffled_trials(labels: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One permutation a seed, all in one frame, numbered by ``trial``."""
    values = [c for c in ("rank", "return_t", "label") if c in labels.columns]
    keep = [c for c in labels.columns if c not in values]
    keys = F.array(*[
        F.struct(F.lit(i).alias("trial"), uniform_key(f"{seed}:from", "trade_date", "ticker").alias("_h"),
                 uniform_key(f"{seed}:to", "trade_date", "ticker").alias("_g"))
        for i, seed in enumerate(seeds)])
    keyed = labels.select("*", F.explode(keys).alias("_k")).select(*labels.columns, "_k.*")
    group = ["trial", "trade_date"]
    source = positions(keyed.select(*group, "ticker", "_h", *values), group, "_h", ["ticker"], "_i").select(*group, "_i", *values)
    target = positions(keyed.select("trial", "_g", *keep), group, "_g", ["ticker"], "_i").select("trial", "_i", *keep)
    return target.join(source, [*group, "_i"]).select("trial", *labels.columns)


def expected_precision(features: DataFrame, k: int, trials: int) -> DataFrame:
    """One row: candidates per day, chance precision ``k / candidates`` and its tolerance."""
    per_day = features.groupBy("trade_date").agg(F.count_distinct("ticker").alias("n"))
    base = per_day.agg(F.count(F.lit(1)).alias("n_days"), F.avg("n").alias("avg_candidates")).withColumn(
        "expected_precision",
        F.least(F.lit(1.0), F.lit(float(k)) / F.when(F.col("avg_candidates") > 0, F.col("avg_candidates"))),
    )
    base = base.withColumn(
        "expected_precision", F.when(F.col("avg_candidates") > 0, F.col("expected_precision"))
    ).withColumn("observations", F.col("n_days") * F.lit(k * trials))
    return base


def tolerance_table(features: DataFrame, k: int = C.TOP_K, trials: int = 5, multiplier: float = 3.0, z: float = 3.0) -> DataFrame:
    base = expected_precision(features, k, trials)
    return base.withColumn(
        "tolerance", random_guess_tolerance(F.col("expected_precision"), F.col("observations"), multiplier, z)
    )


def trial_precision(predictions: DataFrame, labels: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """``trial, precision``: precision@k of every trial's predictions against the true labels, in one job."""
    best = top_k(predictions.select("trial", "trade_date", "ticker", "score"), k, group=("trial", "trade_date"))
    hits = labels.where("label = 1").select("trade_date", "ticker", F.lit(1).alias("_hit"))
    days = (best.join(hits, ["trade_date", "ticker"], "left").groupBy("trial", "trade_date")
            .agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("p")))
    return days.groupBy("trial").agg(F.avg("p").alias("precision"))


def shuffle_label_trials(
    predict_trials: Callable[[DataFrame, DataFrame], DataFrame],
    features: DataFrame,
    labels: DataFrame,
    k: int = C.TOP_K,
    trials: int = 5,
    seed: int = 0,
    multiplier: float = 3.0,
    z: float = 3.0,
) -> DataFrame:
    """One row a trial: its precision on the true labels after learning permuted ones, what chance gives, and the verdict of all.

    ``predict_trials(features, shuffled)`` learns each ``trial`` of the permuted labels by itself and returns
    ``trial, trade_date, ticker, score``.
    """
    shuffled = shuffled_trials(labels, [seed * 1000 + t for t in range(trials)])
    scored = trial_precision(predict_trials(features, shuffled), labels, k)
    chance = tolerance_table(features, k, trials, multiplier, z).select("expected_precision", "tolerance")
    # One row a trial and one row of chance.
    rows = scored.crossJoin(F.broadcast(chance))
    every = W.partitionBy()
    observed = F.avg("precision").over(every)
    return rows.select("trial", "precision", "expected_precision", "tolerance", observed.alias("observed_precision"),
                       F.coalesce(observed <= F.col("tolerance"), F.lit(False)).alias("passed"))


def each_trial(fit_predict: Callable[[DataFrame, DataFrame], DataFrame], trials: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A learner of one label table, refitted on every trial."""
    def predict(features: DataFrame, shuffled: DataFrame) -> DataFrame:
        kept = stored(shuffled)
        parts = [fit_predict(features, kept.where(F.col("trial") == t).drop("trial")).withColumn("trial", F.lit(t)) for t in range(trials)]
        return reduce(DataFrame.unionByName, parts)

    return predict


def shuffle_label_verdict(rows: DataFrame) -> dict:
    """The few rows of ``shuffle_label_trials`` as one verdict; without any row the test has failed."""
    got = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["trial"])
    first = got[0] if got else {"observed_precision": None, "passed": False}
    return {"observed_precision": first["observed_precision"], "passed": first["passed"], "trials": [r["precision"] for r in got]}


# --- L7: sealed period ------------------------------------------------------------------


def seal_violations(df: DataFrame, date_col: str = "trade_date", sealed_from: str = C.SEALED_FROM) -> DataFrame:
    """One row naming the newest date if the frame reaches into the sealed period.

    The period is open-ended, so the maximum decides for the whole frame.
    """
    return df.agg(F.max(date_col).alias("newest"), F.count(F.when(F.col(date_col) >= F.lit(sealed_from).cast("date"), 1)).alias("rows")).where("rows > 0")


def assert_sealed(df: DataFrame, token: str | None = None, date_col: str = "trade_date", sealed_from: str = C.SEALED_FROM) -> None:
    if token == C.UNSEAL_TOKEN or date_col not in df.columns:
        return
    newest = df.agg(F.max(date_col).alias("m")).where(F.col("m") >= F.lit(sealed_from).cast("date"))
    assert_empty(newest, f"frame reaches the sealed period from {sealed_from}")


def sealed(df: DataFrame, token: str | None = None, date_col: str = "trade_date", sealed_from: str | None = C.SEALED_FROM) -> DataFrame:
    """The seal inside the projection: a row of the sealed period raises while rows stream, at no extra pass."""
    if sealed_from is None or token == C.UNSEAL_TOKEN:
        return df
    message = F.concat(F.lit("row of the sealed period: "), F.coalesce(F.col(date_col).cast("string"), F.lit("?")))
    inside = F.col(date_col) >= F.lit(sealed_from).cast("date")
    return df.withColumn(date_col, F.when(inside, F.raise_error(message).cast("date")).otherwise(F.col(date_col)))
