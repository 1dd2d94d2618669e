"""Features of a day from strictly earlier days.

Games of a day are averaged first, so that games of one day never see each other; windows run over days that
end one row before the current one and are joined back to the games. NaN counts as missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("entity_id", "event_date")
#: the order in which the games of a day are added up, whatever their order in the table
ORDER = "game_id"
MEASURES = ("minutes", "points", "extras")
SPANS = (3, 5, 10)
ROLE_STEP = 6.0


def present(c: str) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def day_grain(games: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """A row for each entity and day: games and the mean of each measure, whatever the order of the games.

    Doubles are added up by ORDER, then by value; infinite ones count as missing.
    """
    finite = {m: F.when(F.abs(present(m)) < float("inf"), present(m)) for m in measures}
    order = [ORDER] if ORDER in games.columns else []
    each = F.array_sort(F.collect_list(F.struct(*order, *(x.alias(m) for m, x in finite.items()))))
    days = games.groupBy(*KEYS).agg(F.count("*").alias("games"), each.alias("_games"), *(F.count(x).alias(f"_n_{m}") for m, x in finite.items()))
    total = lambda m: F.aggregate("_games", F.lit(0.0), lambda acc, g: acc + F.coalesce(g[m], F.lit(0.0)))
    return days.select(*KEYS, "games", *(F.try_divide(total(m), F.col(f"_n_{m}")).alias(m) for m in measures))


def _days() -> W:
    return W.partitionBy("entity_id").orderBy("event_date")


def earlier(rows: int | None = None) -> W:
    """The last `rows` days before the current one, or all of them."""
    return _days().rowsBetween(W.unboundedPreceding if rows is None else -rows, -1)


def rolling_mean(c: str, rows: int | None = None) -> Column:
    return F.avg(c).over(earlier(rows))


def rolling_deviation(c: str, rows: int | None = None) -> Column:
    """Population deviation, from two values on."""
    w = earlier(rows)
    return F.when(F.count(c).over(w) >= 2, F.stddev_pop(c).over(w))


def ewm_mean(c: str, span: int, prior: str) -> Column:
    """Exponentially weighted mean of earlier days, unadjusted; missing days keep the mean.

    prior: the number of earlier days with a value. Older values than `reach` weigh less than 2**-60 together, below
    what a double tells apart, so a frame of that many values gives the mean of all.
    """
    alpha = 2.0 / (span + 1)
    reach = math.ceil(-60 * math.log(2) / math.log(1 - alpha))
    past = F.collect_list(c).over(W.partitionBy("entity_id").orderBy(prior).rangeBetween(-reach, -1))
    step = lambda acc, v: F.when(acc.isNull(), v).otherwise(alpha * v + (1 - alpha) * acc)
    return F.aggregate(past, F.lit(None).cast("double"), step)


def day_windows(days: DataFrame, c: str = "minutes") -> DataFrame:
    """days with every feature of measure c."""
    rate = F.try_divide("points", F.nullif(F.col("minutes"), F.lit(0.0)))
    days = days.withColumn("rate", rate).withColumn("_prior", F.count(c).over(earlier()))
    out = days.withColumns(
        {
            "prior_value": F.lag(c, 1).over(_days()),
            "prior_days": F.row_number().over(_days()) - 1,
            "prior_games": F.coalesce(F.sum("games").over(earlier()), F.lit(0)),
            **{f"mean_{n}": rolling_mean(c, n) for n in SPANS},
            "season_mean": rolling_mean(c),
            "deviation_5": rolling_deviation(c, 5),
            "season_deviation": rolling_deviation(c),
            **{f"ewm_{n}": ewm_mean(c, n, "_prior") for n in SPANS},
            "rate_5": rolling_mean("rate", 5),
        }
    )
    delta = F.col("mean_3") - F.col("season_mean")
    return out.drop("_prior").withColumn("role_delta", delta).withColumn("role_change", F.coalesce(F.abs(delta) >= ROLE_STEP, F.lit(False)).cast("int"))


def feature_frame(games: DataFrame) -> DataFrame:
    """games with the features of their day; the right side has one row for each entity and day."""
    features = day_windows(day_grain(games)).drop(*MEASURES, "games", "rate")
    return games.join(features, list(KEYS), "left")
