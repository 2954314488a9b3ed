"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed position in [0, 2^60): the head of the md5 of its id.  A source whose target is
``f`` times its size plus a rest takes each document ``floor(f)`` times, and once more below a threshold of
the position, so that smaller budgets always take a subset of what larger ones take.  The threshold comes
from histograms: sizes summed by source and position bucket (4096 of them), then only the bucket in which
the budget ends is split again, level by level, until it holds one position.  Nothing is sorted but bucket
sums, and the sums are combined before the shuffle, so a hot source costs one row a task and bucket.

Rows with equal ids share a position and are taken alike; a null id counts as the text ``-``.  A null text
has size 0.  A null source is a source of its own, the last one.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut_lineage

#: Sources whose plan is sent to every task at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
POSITION_BITS = 60
LEVEL_BITS = 12


def position(key: str) -> Column:
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("-")).cast("binary"))
    return F.conv(F.substring(digest, 1, POSITION_BITS // 4), 16, 10).cast("long")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, repeat: float) -> DataFrame:
    """``source, source_size, target``: one row a source, from ``source, source_size``.

    Sources by code point, null last, get the weights in turn and share ``budget`` times all sizes; a target
    stops at ``repeat`` times its source's size and the excess goes to the others by weight.  With the
    sources in the order of cap per weight, the first k are capped, k being the least number for which an
    equal share per weight of what is left reaches no later cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    )
    share = (F.lit(float(budget)) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # A source is uncapped if the share computed with all earlier ones capped stays within its own cap.
    level = ranked.withColumn("share", share).withColumn("free", F.col("share") <= F.col("ratio"))
    first = F.min(F.when(F.col("free"), F.struct("ratio", F.col("source").isNull(), "source", "share"))).over(Window.partitionBy())
    return level.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("first").isNotNull() & (F.col("ratio") >= F.col("first.ratio")),
               F.least(F.col("cap"), F.col("first.share") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


def sized(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    """Written once: all later steps read these narrow rows, not the texts."""
    return cut_lineage(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), position(key).alias("position")))


def mix_plan(slim: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """One row a source, from ``sized`` rows: ``source, source_size, target, whole, cut``.

    Each of its documents is taken ``whole`` times, and once more where its position is below ``cut``.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, budget, repeat)
                          .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                          .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    cuts = _thresholds(slim, targets).withColumnRenamed("source", "s")
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return cut_lineage(plan.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")))


def with_copies(docs: DataFrame, plan: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with the plan's columns (prefixed by two underscores) and ``__copies``.

    The plan is sent to every task where its number of rows allows it, and joined by a shuffle beyond.
    """
    side = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    side = F.broadcast(side) if plan.count() <= BROADCAST_SOURCES else side
    copies = F.col("__whole") + F.when(position(key) < F.col("__cut"), 1).otherwise(0)
    return docs.join(side, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__copies", copies.cast("int"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, copies, taken`` (words, repeats counted)."""
    slim = sized(docs, text, source, key)
    out = with_copies(slim, mix_plan(slim, **how))
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"),
                      (F.col("__copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    taken = with_copies(docs, mix_plan(sized(docs, text, source, key), **how), source, key)
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*docs.columns)


def _thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, cut``: positions below ``cut`` get one more copy.

    At each level the buckets wholly below the budget are passed, and the one in which it ends is refined.
    A single position is passed if at least half of it fits the budget, so the error is at most half a
    position's size.
    """
    few = targets.count() <= BROADCAST_SOURCES

    def sent(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if few else side

    done = targets.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("passed"), "need")
    rows = slim.where(F.col("size") > 0)
    for shift in range(POSITION_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = rows.alias("r").join(sent(done).alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))).select("r.*", "b.prefix", "b.passed", "b.need")
        if shift != POSITION_BITS - LEVEL_BITS:
            inside = inside.where(F.shiftright("position", shift + LEVEL_BITS) == F.col("prefix"))
            inside = cut_lineage(inside)
            rows = inside.select("source", "position", "size")
        bars = (inside.groupBy("source", "passed", "need", F.shiftright("position", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket")))
        run = F.col("passed") + F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket"))
        half = F.col("in_bucket") / 2 if shift == 0 else F.lit(0.0)
        # The first bucket that the budget does not pass: need stays within it.
        stop = bars.withColumn("run", run).withColumn("over", (F.col("run") - half) > F.col("need"))
        ends = stop.where("over").groupBy("source").agg(
            F.min(F.struct(F.col("bucket").alias("prefix"), (F.col("run") - F.col("in_bucket")).alias("passed"), "need")).alias("m")).select("source", "m.*")
        # Every bucket passed: the cut lies behind the last one.
        last = stop.groupBy("source").agg(F.max("bucket").alias("last"), F.max("run").alias("all"), F.first("need").alias("need"))
        done = cut_lineage(
            last.alias("l").join(ends.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")), "left")
            .select(F.col("l.source").alias("source"), F.coalesce("e.prefix", F.col("l.last") + 1).alias("prefix"),
                    F.coalesce("e.passed", "l.all").alias("passed"), F.col("l.need").alias("need")))
    return done.select("source", F.col("prefix").alias("cut"))
