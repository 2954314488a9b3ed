"""Cross-sectional ranks, of any number of columns at once.

Cross sections by date use plain windows: the input is read once, all columns share one shuffle by the group and
each costs one sort that can spill.  A date holds at most one row a ticker, so groups stay small beside the data.

For a group without such a bound (the whole table) ``grain`` cuts it into slices of each ranked column by an
order-preserving coarse number of the value, so it spreads over many tasks; ranks inside a slice are added to the
number of rows in the slices before it.  Those numbers, for all columns together, come from one aggregate (one row
a group, column and slice) and travel with the rows: every slice gets one head row that carries its number and goes
first in the slice's window, so nothing is joined back.  This reads the input twice and shuffles it once a column.
Both forms are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

#: Slices of a unit of the fourth root: neighbouring values fall together, whatever their scale.
GRAIN = 64
LAST_SLICE = 1 << 40


def slice_of(value: str | Column, grain: int = GRAIN) -> Column:
    """Coarse number that never falls when the value grows (square roots round correctly); NaN and null come last."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    root = F.signum(v) * F.sqrt(F.sqrt(F.abs(v))) * float(grain)
    bounded = F.least(F.greatest(root, F.lit(-1e9)), F.lit(1e9))
    return F.when(v.isNull(), LAST_SLICE + 1).when(F.isnan(v), LAST_SLICE).otherwise(F.floor(bounded)).cast("long")


#: Slice of a head row in the windows of the other columns: below all slices, spread over as many tasks.
ELSEWHERE, SPREAD = -(1 << 50), 4096
_HEAD = ("_head", "_of", "_slice", "_before", "_total")


def _with_heads(df: DataFrame, group: Sequence[str], slices: Sequence[Column], counted: Sequence[Column], descending: bool = False) -> DataFrame:
    """``df`` with one head row a ranked column (its number ``_of``), group and slice.

    A head row holds ``_before`` (counted rows of the slices before its own) and ``_total`` (of the group);
    ``counted`` is 1 for the rows that count, else 0.  These columns are null in all other rows.
    """
    group = list(group)
    one = [F.struct(F.lit(i).alias("_of"), s.alias("_slice"), c.cast("long").alias("_rows")) for i, (s, c) in enumerate(zip(slices, counted, strict=True))]
    sizes = (df.select(*group, F.explode(F.array(*one)).alias("_one")).select(*group, "_one.*")
             .groupBy(*group, "_of", "_slice").agg(F.sum("_rows").alias("_rows")))
    order = F.when(F.col("_slice") > LAST_SLICE, 1).otherwise(0)
    whole = W.partitionBy(*group, "_of")
    along = whole.orderBy(order, F.desc("_slice") if descending else F.asc("_slice"))
    before = F.coalesce(F.sum("_rows").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.select(*group, F.lit(True).alias("_head"), "_of", "_slice", before.alias("_before"), F.sum("_rows").over(whole).alias("_total"))
    return df.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)


def _slice_window(group: Sequence[str], i: int, piece: Column, *order: Column) -> WindowSpec:
    """Rows of one slice of ranked column ``i``, their head first."""
    elsewhere = F.lit(ELSEWHERE) - F.pmod(F.xxhash64("_of", "_slice"), F.lit(SPREAD))
    own = F.when(~F.col("_head"), piece.cast("long")).when(F.col("_of") == i, F.col("_slice")).otherwise(elsewhere)
    return W.partitionBy(*group, own).orderBy(F.col("_head").desc(), *order)


def with_rank_parts_of(df: DataFrame, group: Sequence[str], values: Sequence[str], grain: float | None = None,
                       made: Callable[[str], dict[str, Column]] | None = None) -> DataFrame:
    """Add ``_rank_<v>`` (min rank, ascending, nulls last), ``_peers_<v>`` (ties) and ``_count_<v>`` (non-null rows) for every value column.

    ``made`` names what is kept of a column's parts instead of them, so that fewer columns travel on.  A value
    column may not be one of the group columns.
    """
    if grain is None:
        for v in values:
            w = W.partitionBy(*group).orderBy(F.col(v).asc_nulls_last())
            carried = df.columns
            # The default running frame includes all ties, so the running count is the last position of a tie.
            first, last = F.rank().over(w).cast("long"), F.count(v).over(w)
            total = F.count(v).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            parts = df.select(*carried, first.alias(f"_rank_{v}"), (last - first + 1).alias(f"_peers_{v}"), total.alias(f"_count_{v}"))
            df = parts if made is None else parts.select(*carried, *[c.alias(n) for n, c in made(v).items()])
        return df
    placed = _with_heads(df, group, [slice_of(v, grain) for v in values], [F.when(F.col(v).isNotNull(), 1).otherwise(0) for v in values])
    for i, v in enumerate(values):
        # The default running frame includes all ties, so the running count is the last position of a tie and
        # rank() its first (less the head): growing frames only, one sort.
        w = _slice_window(group, i, slice_of(v, grain), F.col(v).asc_nulls_last())
        carried = placed.columns
        parts = placed.select(
            *carried, (F.rank().over(w).cast("long") - 1).alias("_first"), F.count(v).over(w).alias("_last"),
            F.first("_before").over(w).alias("_ahead"), F.first("_total").over(w).alias(f"_count_{v}")).select(
            *carried, (F.col("_ahead") + F.col("_first")).alias(f"_rank_{v}"), (F.col("_last") - F.col("_first") + 1).alias(f"_peers_{v}"), f"_count_{v}")
        placed = parts if made is None else parts.select(*carried, *[c.alias(n) for n, c in made(v).items()])
    return placed.where(~F.col("_head")).drop(*_HEAD)


def with_rank_parts(df: DataFrame, group: Sequence[str], value: str, grain: float | None = None) -> DataFrame:
    """Add ``_rank`` (min rank, ascending, nulls last), ``_peers`` (ties) and ``_n`` (non-null rows)."""
    ranked = with_rank_parts_of(df, group, [value], grain)
    return ranked.withColumnsRenamed({f"_rank_{value}": "_rank", f"_peers_{value}": "_peers", f"_count_{value}": "_n"})


def positions_descending(df: DataFrame, group: Sequence[str], value: str, tie_break: Sequence[str], out: str) -> DataFrame:
    """Distinct 1..n positions per group (int): value descending, nulls last, then ``tie_break``."""
    w = W.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), *[F.col(c) for c in tie_break])
    return df.withColumn(out, F.row_number().over(w))


def average_rank(value: str = "") -> Column:
    """Average rank of ties, from the parts of ``value`` (or of the only one)."""
    end = f"_{value}" if value else ""
    return F.col(f"_rank{end}") + (F.col(f"_peers{end}") - 1) / F.lit(2.0)


def average_pct_rank(value: str = "") -> Column:
    """Average rank of ties over the non-null count; null stays null."""
    return average_rank(value) / F.col(f"_count_{value}" if value else "_n")


def add_pct_ranks(df: DataFrame, group: Sequence[str], outs: dict[str, str], **how) -> DataFrame:
    """Percentile ranks of many columns (``value: name``) by one operator."""
    return with_rank_parts_of(df, group, list(outs), made=lambda v: {outs[v]: F.when(F.col(v).isNotNull(), average_pct_rank(v))}, **how)


def add_pct_rank(df: DataFrame, group: Sequence[str], value: str, out: str, **how) -> DataFrame:
    return add_pct_ranks(df, group, {value: out}, **how)


def add_min_rank_desc(df: DataFrame, group: Sequence[str], value: str, out: str, **how) -> DataFrame:
    """Descending rank, ties share the best position, nulls stay null."""
    ranked = with_rank_parts(df, group, value, **how)
    descending = F.col("_n") - (F.col("_rank") - 1) - F.col("_peers") + 1
    return ranked.withColumn(out, F.when(F.col(value).isNotNull(), descending.cast("double"))).drop(
        "_rank", "_peers", "_n"
    )


def top_k(df: DataFrame, k: int, group: Sequence[str] = ("trade_date",), score: str = "score",
          tie_break: Sequence[str] = ("ticker",), position: str | None = None) -> DataFrame:
    """First ``k`` rows per group by score descending.

    ``row_number() <= k`` lets the optimizer insert a per-task group limit before
    the shuffle, so at most ``k`` rows per group and task move.
    """
    name = position or "_pos"
    w = W.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *[F.col(c) for c in tie_break])
    best = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return best if position else best.drop(name)


def positions(df: DataFrame, group: Sequence[str], order_hash: str, tie_break: Sequence[str], out: str) -> DataFrame:
    """1-based position inside each group (long) ordered by a uniform hash column (``uniform_key``)."""
    w = W.partitionBy(*group).orderBy(F.col(order_hash), *[F.col(c) for c in tie_break])
    return df.withColumn(out, F.row_number().over(w).cast("long"))
