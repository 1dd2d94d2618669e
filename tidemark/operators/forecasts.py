"""Scoring forecasts, choosing between them as time passes, and calibrating intervals.

State of a date is made of strictly earlier dates: sums per date first, then running sums over dates, so nothing
of a day reaches its own predictions and no step loops over dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import written

CANDIDATES = ("prior_value", "mean_3", "mean_5", "mean_10", "season_mean", "ewm_5")
LEAST_ERRORS = 100
DEFAULT = "mean_5"
ALPHA = 0.1
SHRINK = 250
#: bins of one minute of error, and of one bin, in the running counts
BINS = 32
HISTORY = ((9, "5-9"), (19, "10-19"))


def long_form(days: DataFrame, candidates: tuple[str, ...] = CANDIDATES, actual: str = "minutes") -> DataFrame:
    """A row for each day and candidate with an estimate."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(c).alias("candidate"), F.col(c).alias("estimate")) for i, c in enumerate(candidates)))).alias("e")
    rows = days.select("entity_id", "event_date", F.col(actual).alias("actual"), "prior_games", "role_change", cells)
    rows = rows.select("entity_id", "event_date", "actual", "prior_games", "role_change", "e.*")
    return rows.where("estimate is not null and actual is not null").withColumn("error", F.abs(F.col("actual") - F.col("estimate")))


def history_group(c: str = "prior_games") -> Column:
    out = F.lit("20+")
    for most, name in reversed(HISTORY):
        out = F.when(F.col(c) <= most, name).otherwise(out)
    return out


def mean_errors(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "candidate").agg(F.count("*").alias("n"), F.avg("error").alias("mae"))


def segment_errors(rows: DataFrame) -> DataFrame:
    """Mean errors of overlapping segments: all, role, history; one grouping over exploded labels."""
    labels = F.array(F.lit("overall"), F.when(F.col("role_change") == 1, "role_change").otherwise("stable"), F.concat(F.lit("history_"), history_group()))
    return mean_errors(rows.withColumn("segment", F.explode(labels)), "segment")


def running(rows: DataFrame, by: tuple[str, ...], **sums: Column) -> DataFrame:
    """Sums over strictly earlier dates, a row for each combination of by and date."""
    daily = rows.groupBy(*by, "event_date").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    before = W.partitionBy(*by).orderBy("event_date").rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy("event_date").rowsBetween(W.unboundedPreceding, -1)
    return daily.select(*by, "event_date", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums))


def selected(rows: DataFrame, warm_up: int, least: int = LEAST_ERRORS) -> DataFrame:
    """The forecast of the candidate with the least mean error so far, ties by order; DEFAULT until each has
    `least` errors. Dates of the warm-up are learnt from but not forecast."""
    past = running(rows, ("candidate", "rank"), errors=F.col("error"), n=F.lit(1))
    mean = F.when(F.col("n") >= least, F.try_divide("errors", "n"))
    best = past.groupBy("event_date").agg(F.min_by("candidate", F.when(mean.isNotNull(), F.struct(mean, "rank"))).alias("best"))
    dates = rows.select("event_date").distinct().withColumn("nth", F.row_number().over(W.orderBy("event_date")) - 1)
    chosen = dates.where(F.col("nth") >= warm_up).join(best, "event_date").select("event_date", F.coalesce("best", F.lit(DEFAULT)).alias("candidate"))
    return rows.join(chosen, ["event_date", "candidate"])


def _cell_of(counts: DataFrame, wanted: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """wanted(keys, event_date, day, k, ...) with the cell that holds the k-th least error of earlier days, and k within it.

    counts(keys, cell, day, c): errors by cell and day. Counts up to each wanted day are running sums by cell, so what a
    day meets is the cells of its keys, never its errors.
    """
    by_day = counts.groupBy(*keys, cell, "day").agg(F.sum("c").alias("c"))
    asked = by_day.select(*keys, cell).distinct().join(wanted.select(*keys, "day").distinct(), keys)
    both = by_day.withColumn("asked", F.lit(0)).unionByName(asked.withColumns({"c": F.lit(0).cast("long"), "asked": F.lit(1)}))
    earlier = W.partitionBy(*keys, cell).orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    both = both.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).where("asked = 1 and before > 0")
    upto = F.sum("before").over(W.partitionBy(*keys, "day").orderBy(cell))
    placed = wanted.join(both.select(*keys, cell, "day", "before", upto.alias("upto")), [*keys, "day"])
    return placed.where("upto >= k and upto - before < k").withColumn("k", F.col("k") - F.col("upto") + F.col("before")).drop("upto", "before")


def conformal(rows: DataFrame, *by: str, alpha: float = ALPHA) -> DataFrame:
    """Half-width for each date and group: order statistic min(n, ceil((n+1)(1-alpha))) of the errors of strictly
    earlier dates.

    Found by counts in three steps: the bin that holds it, a part of that bin, and the error itself among the
    different errors of that part. A date never gathers its history, and only counts by day are shuffled.
    """
    keys = [*by, "all"]
    bin_, part = F.floor(F.col("error") * BINS), F.floor(F.col("error") * BINS * BINS * BINS)
    counts = rows.select(*by, F.lit(0).alias("all"), "event_date", F.unix_date(F.to_date("event_date")).alias("day"), "error")
    counts = written(counts.groupBy(*keys, "event_date", "day", "error").agg(F.count("*").alias("c")).withColumns({"bin": bin_, "part": part}), "errors")
    daily = counts.groupBy(*keys, "event_date", "day").agg(F.sum("c").alias("c"))
    n = F.sum("c").over(W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, -1))
    wanted = daily.select(*keys, "event_date", "day", n.alias("n")).where("n > 0")
    wanted = wanted.withColumn("k", F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(1 - alpha))))
    for cell in ("bin", "part", "error"):
        wanted = _cell_of(counts, wanted, keys, cell)
        keys = [*keys, cell]
    return wanted.select(*by, "event_date", "n", F.col("error").alias("width"))


def leveled(rows: DataFrame, levels: tuple[tuple[str, ...], ...]) -> DataFrame:
    """rows once for each level, with its number and the values of its columns as cell."""
    cell = lambda names: F.to_json(F.struct(*names)) if names else F.lit("")
    return rows.select("event_date", "error", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), cell(names).alias("cell")) for i, names in enumerate(levels)))).alias("_l")).select("event_date", "error", "_l.*")


def intervals(rows: DataFrame, widths: DataFrame, *by: str) -> DataFrame:
    out = rows.join(widths, [*by, "event_date"])
    out = out.withColumn("lower", F.greatest(F.lit(0.0), F.col("estimate") - F.col("width"))).withColumn("upper", F.least(F.lit(60.0), F.col("estimate") + F.col("width")))
    return out.withColumn("covered", F.col("actual").between(F.col("lower"), F.col("upper")).cast("int"))


def shrunk(rows: DataFrame, strength: int = SHRINK) -> DataFrame:
    """Width of the role's own errors, pulled to the pooled width by n / (n + strength)."""
    pooled = conformal(rows).select("event_date", F.col("width").alias("pooled"))
    own = conformal(rows, "role_change")
    weight = F.col("n") / (F.col("n") + strength)
    return own.join(pooled, "event_date").select("role_change", "event_date", "n", (weight * F.col("width") + (1 - weight) * F.col("pooled")).alias("width"))


RECENT = 8
LEAST_RECENT = 3
VOLATILE = 5.0
LEAST_CELL = 100
CELLS = (("role_change",), ("role_change", "history"), ("role_change", "history", "volatility"))


def with_cells(rows: DataFrame) -> DataFrame:
    """One candidate's rows with history group and volatility: high if the mean of the entity's RECENT errors of
    earlier days, LEAST_RECENT at least, is above VOLATILE."""
    recent = W.partitionBy("entity_id").orderBy("event_date").rowsBetween(-RECENT, -1)
    high = (F.count("error").over(recent) >= LEAST_RECENT) & (F.avg("error").over(recent) > VOLATILE)
    return rows.withColumn("history", history_group()).withColumn("volatility", F.when(high, "high").otherwise("low"))


def cascade(rows: DataFrame, least: int = LEAST_CELL) -> DataFrame:
    """rows of with_cells with width and level: that of the finest cell with `least` earlier errors, else pooled.

    All levels are calibrated in one pass over the rows.
    """
    levels = ((), *CELLS)
    names = ["pooled", *("+".join(c) for c in CELLS)]
    widths = conformal(leveled(rows, levels), "level", "cell").where((F.col("level") == 0) | (F.col("n") >= least))
    cells = F.array(*(F.struct(F.lit(i).alias("level"), (F.to_json(F.struct(*c)) if c else F.lit("")).alias("cell")) for i, c in enumerate(levels)))
    of = rows.select("event_date", *CELLS[-1]).distinct().withColumn("_l", F.explode(cells)).select("event_date", *CELLS[-1], "_l.*")
    best = of.join(widths, ["event_date", "level", "cell"]).groupBy("event_date", *CELLS[-1]).agg(F.max_by(F.struct("level", "width"), "level").alias("b"))
    best = best.select("event_date", *CELLS[-1], F.col("b.width").alias("width"), F.element_at(F.array(*map(F.lit, names)), F.col("b.level") + 1).alias("level"))
    keys = ["event_date", *CELLS[-1]]
    return rows.join(best, keys).select(*keys, *(c for c in rows.columns if c not in keys), "width", "level")


SUMMARY = ("n", "dates", "coverage", "mean_width", "mae", "over_5", "over_10", "over_15")


def interval_summary(rows: DataFrame, dimensions: tuple[str, ...], always: tuple[str, ...] = ()) -> DataFrame:
    """Each dimension by itself and the whole, in one pass of grouping sets; `always` is in every set."""
    sets = [[*always, c] for c in dimensions] + [[*always]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *always, *dimensions)
    over = lambda x: F.avg((F.col("error") > x).cast("double")).alias(f"over_{x}")
    width = F.avg(F.col("upper") - F.col("lower")).alias("mean_width")
    return grouped.agg(F.count("*").alias("n"), F.countDistinct("event_date").alias("dates"), F.avg("covered").alias("coverage"), width, F.avg("error").alias("mae"), over(5), over(10), over(15))


def season_phase(rows: DataFrame, day: str = "event_date") -> DataFrame:
    """rows with the third of the span of all days that theirs falls in; a third holds its last day."""
    span = rows.agg(F.min(day).alias("_first"), F.greatest(F.datediff(F.max(day), F.min(day)), F.lit(1)).alias("_days"))
    into = F.datediff(day, "_first") * 3
    phase = F.when(into <= F.col("_days"), "early").when(into <= F.col("_days") * 2, "middle").otherwise("late")
    return rows.join(F.broadcast(span)).withColumn("phase", phase).drop("_first", "_days")  # span is one row


def paired(rows: DataFrame, keys: list[str], equal: list[str], base: str, other: str) -> DataFrame:
    """Rows of methods base and other side by side, with what must be equal and isn't in `differs`.

    PAIRED, or DUPLICATE_METHOD_ROW, UNPAIRED where a method has several rows or none, or UNEQUAL_FIELDS.
    """
    side = lambda m: F.when(F.col("method") == m, F.struct(*(c for c in rows.columns if c not in (*keys, "method"))))
    both = rows.where(F.col("method").isin(base, other)).groupBy(*keys).agg(F.count_if(F.col("method") == base).alias("n_base"), F.count_if(F.col("method") == other).alias("n_other"), F.first(side(base), True).alias("base"), F.first(side(other), True).alias("other"))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"base.{c}").eqNullSafe(F.col(f"other.{c}")), c) for c in equal)))
    status = F.when((F.col("n_base") > 1) | (F.col("n_other") > 1), "DUPLICATE_METHOD_ROW").when((F.col("n_base") == 0) | (F.col("n_other") == 0), "UNPAIRED").when(F.size(differs) > 0, "UNEQUAL_FIELDS").otherwise("PAIRED")
    return both.select(*keys, status.alias("status"), F.when(status == "UNEQUAL_FIELDS", differs).alias("differs"), "base", "other")


def block_bootstrap(daily: DataFrame, draws: DataFrame) -> DataFrame:
    """daily(nth, gain, n), draws(rep, nth): ratio of sums for each replicate, then its mean and 95 % interval."""
    each = draws.join(daily, "nth").groupBy("rep").agg((F.sum("gain") / F.sum("n")).alias("ratio"))
    q = lambda p: F.percentile("ratio", F.lit(p))
    return each.agg(F.count("*").alias("reps"), F.avg("ratio").alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"))
