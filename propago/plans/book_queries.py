"""Order-book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from propago.operators import book as b
from propago.operators import summary as a
from propago.plans.registry import query
from propago.plans.sequence_queries import SYMBOL
from propago.session import cut
from propago.sources import capture as c
from propago.sources import views as v
from propago.streaming import tape as s

_STATES_SQL = (
    v.LEVELS_SQL
    + """, kept AS (SELECT symbol, update, side, price, arg_max(quantity, pos) AS quantity FROM level_updates GROUP BY ALL),
live AS (SELECT * FROM (SELECT *, lead(update) OVER (PARTITION BY symbol, side, price ORDER BY update) AS upto FROM kept) WHERE quantity > 0),
ids AS (SELECT DISTINCT symbol, update FROM level_updates),
ranked AS (SELECT i.symbol, i.update, side, price, quantity, row_number() OVER (PARTITION BY i.symbol, i.update, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rank
  FROM ids i JOIN live l ON i.symbol = l.symbol AND l.update <= i.update AND (upto IS NULL OR upto > i.update)),
states AS (SELECT symbol, update, max(price) FILTER (side = 'bid' AND rank = 1) AS best_bid, max(price) FILTER (side = 'ask' AND rank = 1) AS best_ask,
  coalesce(sum(quantity) FILTER (side = 'bid' AND rank <= 1), 0) AS b1, coalesce(sum(quantity) FILTER (side = 'ask' AND rank <= 1), 0) AS a1,
  coalesce(sum(quantity) FILTER (side = 'bid' AND rank <= 5), 0) AS b5, coalesce(sum(quantity) FILTER (side = 'ask' AND rank <= 5), 0) AS a5,
  coalesce(sum(quantity) FILTER (side = 'bid' AND rank <= 10), 0) AS bid_depth, coalesce(sum(quantity) FILTER (side = 'ask' AND rank <= 10), 0) AS ask_depth,
  count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels FROM ranked GROUP BY symbol, update),
book AS (SELECT symbol, update, best_bid, best_ask, (best_bid + best_ask) / 2 AS mid, best_ask - best_bid AS spread, round((b1 - a1) / nullif(b1 + a1, 0), 6) AS imb1, round((b5 - a5) / nullif(b5 + a5, 0), 6) AS imb5,
  round(bid_depth, 4) AS bid_depth, round(ask_depth, 4) AS ask_depth, bid_levels, ask_levels FROM states)"""
)


#: Many short series: a symbol is one chunk (see the operator for long ones).
CHUNK = None


def states(spark, sf_dir, top=False):
    return b.replay(v.level_updates(spark, sf_dir), SYMBOL, top=top, chunk=CHUNK)


def _rounded(df, *more):
    r = lambda c, d: F.round(c, d).alias(c)
    return df.select("symbol", "update", "best_bid", "best_ask", "mid", "spread", r("imb1", 6), r("imb5", 6), r("bid_depth", 4), r("ask_depth", 4), *(c for c in ("bid_levels", "ask_levels") if c in df.columns), *more)


@query(_STATES_SQL + " SELECT * FROM book")
def book_replay(spark, sf_dir):
    return _rounded(states(spark, sf_dir).filter("bid_levels + ask_levels > 0"))


@query(_STATES_SQL + " SELECT *, 0::BIGINT AS gaps FROM book")
def streamed_book_replay(spark, sf_dir):
    """The same states from a stream: three batches of updates by number, each symbol's in one file of each."""
    at = c.scratch(spark, "stream")
    levels = cut(v.level_updates(spark, sf_dir).withColumns({"first_seq": F.col("update"), "last_seq": F.col("update")}))
    parts = [F.col("update") <= 200, (F.col("update") > 200) & (F.col("update") <= 400), F.col("update") > 400]
    for part in parts:
        levels.filter(part).repartition("symbol").write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(levels.schema).option("maxFilesPerTrigger", 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).parquet(f"{at}/in")
    out = s.run_once(s.book_states(stream), f"{at}/out", f"{at}/state").filter("bid_levels + ask_levels > 0")
    return _rounded(out, "gaps")


@query(_STATES_SQL + " SELECT symbol, update, best_bid, best_ask, mid, spread, imb1, imb5, bid_depth, ask_depth FROM book")
def book_snapshots(spark, sf_dir):
    """The features after every update, from the ranked levels in relational form."""
    return _rounded(b.features_of(b.top_levels(states(spark, sf_dir, True), SYMBOL), SYMBOL))


@query(_STATES_SQL + " SELECT symbol, update, side, rank, price, quantity FROM ranked WHERE rank <= 10")
def top_levels(spark, sf_dir):
    out = b.top_levels(states(spark, sf_dir, True), SYMBOL)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(_STATES_SQL + " SELECT symbol, count(*) FILTER (best_bid >= best_ask) AS crossed, count(*) AS states FROM book GROUP BY symbol")
def crossed_books(spark, sf_dir):
    seen = states(spark, sf_dir).filter("bid_levels + ask_levels > 0")
    return seen.groupBy("symbol").agg(F.count_if("crossed").alias("crossed"), F.count(F.lit(1)).alias("states"))


@query(
    _STATES_SQL
    + """, cuts AS (SELECT symbol, quantile_cont(imb5, 0.3333333333333333::DOUBLE) AS lo, quantile_cont(imb5, 0.6666666666666666::DOUBLE) AS hi FROM book WHERE update <= 300 GROUP BY symbol)
SELECT symbol, (imb5 >= lo - 1e-9)::INT + (imb5 >= hi - 1e-9)::INT AS state, count(*) AS n FROM book JOIN cuts USING (symbol) WHERE imb5 IS NOT NULL GROUP BY ALL"""
)
def imbalance_state(spark, sf_dir):
    # Written, since both the cuts and the classes read it: one replay.
    seen = cut(states(spark, sf_dir).filter("imb5 IS NOT NULL").select("symbol", "update", F.round("imb5", 6).alias("imb5")))
    cuts = a.tercile_cuts(seen, SYMBOL, "imb5", F.col("update") <= 300).withColumn("cuts", F.transform("cuts", lambda x: x - 1e-9))
    return a.classify(seen, cuts, SYMBOL, "imb5", "state").groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))


@query(v.LEVELS_SQL + ", per AS (SELECT symbol, update, count(*) AS n FROM level_updates GROUP BY ALL) SELECT symbol, median(n) AS p50, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, max(n) AS most FROM per GROUP BY symbol")
def levels_per_update(spark, sf_dir):
    packed = v.level_updates(spark, sf_dir).groupBy("symbol", "update").agg(
        *(F.collect_list(F.when(F.col("side") == side, F.struct(F.col("price").cast("decimal(38,18)").alias("price"), F.col("quantity").cast("decimal(38,18)").alias("quantity")))).alias(f"{side}s") for side in ("bid", "ask"))
    )
    sized = b.level_counts(packed)
    return sized.groupBy("symbol").agg(F.median("levels").alias("p50"), F.round(F.percentile("levels", F.lit(0.9)), 6).alias("p90"), F.max("levels").cast("long").alias("most"))
