"""Draws of the bootstrap."""

from tidemark.operators import forecasts as fc
from tidemark.plans import forecasting


def test_hash_draws_give_an_interval(spark):
    daily = spark.createDataFrame([(i, float(i % 7), 1) for i in range(30)], "nth long, gain double, n long")
    at = lambda draw: spark.range(500).selectExpr("id as rep", "30L as d", "explode(sequence(0L, 29L)) as pos").selectExpr("rep", f"{draw} as nth")
    drawn = at(forecasting.MD5_DRAW)
    r = fc.block_bootstrap(daily, drawn).first()
    assert r.reps == 500 and r.low < r.mean < r.high and r.high - r.low > 0.5
    assert max(x["count"] for x in drawn.where("rep = 3").groupBy("nth").count().collect()) > 1
    assert drawn.selectExpr("min(nth)", "max(nth)").first() == (0, 29)
