"""Does a new feature block add anything beyond the incumbents?

All ranks are windows inside a day, those of a part of its rows too (the part is one more partition column), so rows
move once to their day and every figure of a day comes from one aggregate there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitrank.operators.moments import pooled_covariances, product_sums, unexplained_share, with_cholesky
from pitrank.operators.ranks import average_rank, with_rank_parts_of
from pitrank.session import stored

# Stop thresholds and the incumbent block.
MAX_SPEARMAN = 0.90
MIN_RESIDUAL_SHARE = 0.10
ANCHOR = "xs_vol_rank"
INCUMBENTS = ("vol5", "vol20", "xs_vol_rank", "relvol_prev", "dist52", "logpx")


def _with_pair_ranks(features: DataFrame, new: Sequence[str], anchor: str) -> DataFrame:
    """``_x<i>`` and ``_y<i>``: ranks of the i-th new feature and of the anchor among the day's rows with both, less their mean, else null."""
    # By the day alone, so that every part of it lies there too; rows that lie so already do not move.
    out = features.repartition("trade_date").withColumns({c: F.col(c).cast("double") for c in dict.fromkeys([anchor, *new])})
    for i, c in enumerate(new):
        out = out.withColumn(f"_pair{i}", F.col(anchor).isNotNull() & F.col(c).isNotNull())
        names = {c: f"_x{i}", anchor: f"_y{i}"}
        # The anchor against itself has one rank, for both sides.
        made = lambda v, i=i, names=names: {names[v]: F.when(F.col(f"_pair{i}"), average_rank(v) - (F.col(f"_count_{v}") + 1) / F.lit(2.0))}
        out = with_rank_parts_of(out, ["trade_date", f"_pair{i}"], list(names), made=made)
        if c == anchor:
            out = out.withColumn(f"_x{i}", F.col(f"_y{i}"))
    return out


def _pair_sums(new: Sequence[str]) -> list[Column]:
    def product(a: str, b: str, out: str) -> Column:
        return F.sum(F.col(a) * F.col(b)).alias(out)

    return [s for i in range(len(new)) for s in (
        F.count(f"_x{i}").alias(f"_n{i}"), product(f"_x{i}", f"_y{i}", f"_xy{i}"), product(f"_x{i}", f"_x{i}", f"_xx{i}"), product(f"_y{i}", f"_y{i}", f"_yy{i}"))]


def _spearman_rows(daily: DataFrame, new: Sequence[str]) -> DataFrame:
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n"), F.col(f"_xy{i}").alias("c"), F.sqrt(F.col(f"_xx{i}") * F.col(f"_yy{i}")).alias("s")) for i, c in enumerate(new)]
    rows = daily.select("trade_date", F.explode(F.array(*each)).alias("f")).select("trade_date", "f.*").where("s > 0")
    return rows.select("trade_date", "feature", "n", (F.col("c") / F.col("s")).alias("spearman"))


def daily_spearman(features: DataFrame, new: Sequence[str], anchor: str = ANCHOR) -> DataFrame:
    """Spearman of every new feature with the anchor, per day, over rows with both present."""
    narrow = features.select("trade_date", *dict.fromkeys([anchor, *new]))
    return _spearman_rows(_with_pair_ranks(narrow, new, anchor).groupBy("trade_date").agg(*_pair_sums(new)), new)


def _with_centred(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_p<i>``: centred per-day percentile rank of the i-th column among the rows with all of them (``_complete``), else null."""
    def centre(c: str) -> dict:
        n = F.col(f"_count_{c}")
        return {f"_p{cols.index(c)}": F.when(F.col("_complete"), average_rank(c) / n - (n + 1) / (2 * n))}

    present = None
    for c in cols:
        # Missing is null or NaN, as in ``na.drop``.
        here = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        present = here if present is None else present & here
    return with_rank_parts_of(features.withColumn("_complete", present), ["trade_date", "_complete"], cols, made=centre)


def _centred_sums(cols: Sequence[str]) -> list[Column]:
    return product_sums([f"_p{i}" for i in range(len(cols))], F.col("_complete"))


def _shares(daily: DataFrame, new: Sequence[str], incumbents: Sequence[str]) -> DataFrame:
    size = len(incumbents)
    solved = with_cholesky(pooled_covariances(daily, size + len(new)), size, len(new))
    shares = F.array(*[F.struct(F.lit(c).alias("feature"), unexplained_share(size, size + i).alias("residual_share")) for i, c in enumerate(new)])
    return solved.select(F.explode(shares).alias("s")).select("s.*")


def residual_share(features: DataFrame, new: Sequence[str], incumbents: Sequence[str] = INCUMBENTS) -> DataFrame:
    """``feature, residual_share``: what is left of each new feature's variance after a linear projection on the incumbents.

    Everything is moved to centred per-day percentile ranks first; the projections of all features come from one
    co-moment aggregate.
    """
    cols = [*incumbents, *new]
    centred = _with_centred(features.select("trade_date", *dict.fromkeys(cols)).repartition("trade_date"), cols)
    return _shares(centred.groupBy("trade_date").agg(*_centred_sums(cols)), new, incumbents)


def redundancy_gate(features: DataFrame, new: Sequence[str], anchor: str = ANCHOR,
                    incumbents: Sequence[str] = INCUMBENTS) -> DataFrame:
    """Verdict per new feature; ``stop`` only when every one is redundant."""
    cols = [*incumbents, *new]
    narrow = features.select("trade_date", *dict.fromkeys([anchor, *cols]))
    ranked = _with_centred(_with_pair_ranks(narrow, new, anchor), cols)
    # One row a calendar day.
    daily = stored(ranked.groupBy("trade_date").agg(*_pair_sums(new), *_centred_sums(cols)))
    mean_rho = _spearman_rows(daily, new).groupBy("feature").agg(F.avg("spearman").alias("spearman"))
    verdicts = mean_rho.join(_shares(daily, new, incumbents), "feature").withColumn(
        "redundant", (F.abs("spearman") >= MAX_SPEARMAN) | (F.col("residual_share") < MIN_RESIDUAL_SHARE)
    )
    # One row a feature: few rows, whatever the size of the data.
    verdicts = stored(verdicts)
    everything = verdicts.agg(F.min("redundant").alias("stop"))
    return verdicts.crossJoin(F.broadcast(everything))
