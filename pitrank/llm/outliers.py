"""Quality rules: robust multivariate outliers, with DataFrame functions only.

Each text gives a vector of transformed statistics.  Per language and source the location and scatter of the
vectors are estimated by the minimum covariance determinant: starting from medians and quartile ranges, the
rows nearest to the current estimate (three quarters of them, by Mahalanobis distance) give the next one.  A
text far from the final estimate is rejected.

A step is one aggregation: squared distances fall into logarithmic bins, moments are summed by group and bin
(combined before the shuffle, so a hot group costs a few hundred rows a task), and the bins up to the needed
share are added up.  Nothing is sorted or collected but bins.

Groups of fewer than ``min_rows`` texts are pooled by language, what is left of those all together; with
fewer than ``min_rows`` even then only the base rules apply.  A null language or source is a value of its own.

Edge cases: null and empty texts have no words and fail the base rule; repeated rows count as often as they
occur; an empty table gives an empty result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, WORD, cut_lineage

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARE = 0.75
#: Resolution of each transformed statistic: one word, symbol, three-word window or capital more or less in a text
#: of 100 words (400 letters); for lines, of which a text has few, the rounding error of one in six (1/6/sqrt(12)).
#: Its square is added to the estimated variance, so that a statistic without spread in a group still has a scale.
FLOORS = (0.01, 0.05, 0.05, 0.03, 0.01)
#: About the 0.9999 quantile of chi-squared with five degrees of freedom.
CUTOFF = 25.7
MIN_ROWS = 40
STEPS = 4

DIMS = range(len(FLOORS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a lambda variable is not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, the first included."""
    def covered(places: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), F.lit(0), lambda acc, k: acc + F.when(k == 0, 3).otherwise(
            F.least(F.lit(3), F.get(places, k) - F.get(places, k - 1))))

    def found(sorted_windows: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            same = [F.coalesce(F.get(sorted_windows, i + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
            return same[0] | same[1]
        return _let(F.sort_array(F.transform(F.filter(sorted_windows, again), lambda x: x["i"])),
                    lambda p: F.when(F.size(p) == 0, 0).otherwise(covered(p)))

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, of_hashes))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper`` (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    of_words = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    counted = docs.withColumns({
        "__w": of_words, "__l": of_lines,
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long"),
    })
    return counted.withColumns({
        "n_words": F.col("__w.n").cast("long"), "n_repeat_words": F.col("__w.again").cast("long"),
        "n_lines": F.col("__l.n").cast("long"), "n_dup_lines": F.col("__l.again").cast("long"),
    }).drop("__w", "__l")


def _vector() -> list[Column]:
    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))
    mean_word = F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(0.5)))
    return [mean_word, F.sqrt(share("n_symbols", "word_chars")), share("n_dup_lines", "n_lines"),
            share("n_repeat_words", "n_words"), F.sqrt(share("n_upper", "word_chars"))]


def _groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """``lang, source, group``: the group whose estimate applies; null where no group has enough rows."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < min_rows, F.col("n"))
    by_lang = sizes.withColumn("left", F.sum(small).over(Window.partitionBy("lang")))
    level = F.when(F.col("n") >= min_rows, 0).when(F.col("left") >= min_rows, 1).otherwise(2)
    placed = by_lang.withColumn("level", level)
    rest = placed.where("level = 2").agg(F.sum("n").alias("rest_n"))
    name = (F.when(F.col("level") == 0, F.to_json(F.struct("level", "lang", "source")))
            .when(F.col("level") == 1, F.to_json(F.struct("level", "lang")))
            .when(F.col("rest_n") >= min_rows, F.to_json(F.struct("level"))))
    return placed.crossJoin(F.broadcast(rest)).select("lang", "source", name.alias("group"))  # one row


def _start(rows: DataFrame) -> DataFrame:
    """``group, m0.., w00..``: medians and quartile ranges from histograms of each statistic."""
    grain = 256
    long = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(f"z{i}") * grain) for i in DIMS])).alias("dim", "bin"))
    bars = long.groupBy("group", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("group", "dim")
    run = F.sum("n").over(part.orderBy("bin"))
    placed = bars.withColumns({"run": run, "all": F.sum("n").over(part)})
    at = {q: F.min(F.when(F.col("run") >= q * F.col("all"), F.col("bin"))) for q in (0.25, 0.5, 0.75)}
    quarters = placed.groupBy("group", "dim").agg(((at[0.5] + 0.5) / grain).alias("m"), ((at[0.75] - at[0.25]) / grain / 1.349).alias("s"))
    floors = F.array(*map(F.lit, FLOORS))
    scale = 1 / F.greatest(F.col("s"), F.element_at(floors, F.col("dim") + 1))
    wide = quarters.groupBy("group").agg(*[F.max(F.when(F.col("dim") == i, F.col("m"))).alias(f"m{i}") for i in DIMS],
                                         *[F.max(F.when(F.col("dim") == i, scale)).alias(f"w{i}{i}") for i in DIMS])
    return wide.withColumns({f"w{i}{j}": F.lit(0.0) for i in DIMS for j in range(i)})


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance: |W (z - m)|^2, W the inverse Cholesky factor."""
    joined = rows.join(estimate, "group")
    total = F.lit(0.0)
    for i in DIMS:
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}"))
        total = total + y * y
    return joined.select(*rows.columns, total.alias("d2"))


def _concentrate(rows: DataFrame, estimate: DataFrame, share: float, factor: float) -> DataFrame:
    """Next estimate from the ``share`` of each group that is nearest to this one."""
    pairs = [(i, j) for i in DIMS for j in range(i + 1)]
    near = _distance(rows, estimate).withColumn("bin", F.floor(16 * F.log(F.col("d2") + 1e-3)))
    sums = near.groupBy("group", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in DIMS],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in pairs])
    part = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sums.withColumns({"before": before, "all": F.sum("n").over(part)}).where(F.col("before") < share * F.col("all"))
    total = kept.groupBy("group").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("group", "bin")])
    out = total.select("group", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in DIMS], *[
        (F.greatest(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n"), F.lit(0.0 if i == j else -1e9)) * factor
         + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs])
    return _inverse_factor(out).select("group", *[f"m{i}" for i in DIMS], *[f"w{i}{j}" for i, j in pairs])


def _inverse_factor(df: DataFrame) -> DataFrame:
    """``w``: inverse of the Cholesky factor of the scatter ``c``; both lower triangles."""
    for j in DIMS:
        rest = F.col(f"c{j}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 / 16))))
        below = {}
        for i in range(j + 1, len(FLOORS)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = rest / F.col(f"l{j}{j}")
        df = df.withColumns(below) if below else df
    for i in DIMS:
        for j in range(i, -1, -1):
            total = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                total = total - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            df = df.withColumn(f"w{i}{j}", total / F.col(f"l{i}{i}"))
    return df


def consistency(share: float, dims: int) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal vectors that of all of them."""
    x = np.linspace(1e-9, 200, 2_000_001)

    def below(k: int) -> np.ndarray:
        density = x ** (k / 2 - 1) * np.exp(-x / 2)
        run = np.cumsum(density)
        return run / run[-1]
    q = np.searchsorted(below(dims), share)
    return float(share / below(dims + 2)[q])


def robust_quality(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", *,
                   share: float = SHARE, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS, steps: int = STEPS,
                   min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """One row a document: the statistics, ``base_failed``, ``d2`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` percent repeated ones.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    stats = text_statistics(slim).drop("text")
    rows = cut_lineage(stats.withColumns({f"z{i}": z for i, z in enumerate(_vector())}))
    names = cut_lineage(_groups(rows, min_rows))
    same = F.col("r.lang").eqNullSafe(F.col("g.lang")) & F.col("r.source").eqNullSafe(F.col("g.source"))
    grouped = cut_lineage(rows.alias("r").join(names.alias("g"), same).select("r.*", "g.group"))
    vectors = grouped.where(F.col("group").isNotNull() & (F.col("n_words") > 0)).select("group", *[f"z{i}" for i in DIMS])
    estimate = cut_lineage(_start(vectors))
    factor = consistency(share, len(FLOORS))
    for _ in range(steps):
        estimate = cut_lineage(_concentrate(vectors, estimate, share, factor))
    found = _distance(grouped, estimate)
    without = grouped.join(estimate.select("group"), "group", "left_anti").withColumn("d2", F.lit(None).cast("double"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return found.unionByName(without).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))
