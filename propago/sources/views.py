"""Adapter views: driver tables as fills, event tape, state steps, book levels and sequence ranges.

A ``symbol`` (or tape ``seg``) is the unit of order: every sequence operator partitions by it, so work spreads over as
many tasks as there are symbols. Times are LongType nanoseconds, since Spark's timestamps stop at microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propago.session import dealt

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
#: Edges of mark classes and of state classes (imbalance) on the test tables.
MARK_EDGES = (15.0, 35.0, 100.0)
STATE_CUTS = (-0.2, 0.2)


def ns(column: str) -> Column:
    """Nanoseconds since the epoch, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))") * F.lit(1000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digitize(x: Column, edges) -> Column:
    """The number of edges at or below x: bins closed on the left."""
    total = F.lit(0)
    for e in edges:
        total = total + (x >= F.lit(e)).cast("int")
    return total


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trade fills, one symbol a supplier, in a total capture order."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return dealt(table(spark, sf_dir, "lineitem"), "l_suppkey").select(
        F.col("l_suppkey").alias("symbol"),
        F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("long").alias("capture_seq"),
        ns("l_shipdate").alias("timestamp_ns"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("aggressor"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_orderkey").alias("trade_id"),
    )


FILLS_SQL = """fills AS (
  SELECT l_suppkey AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS capture_seq,
    epoch_us(l_shipdate) * 1000 AS timestamp_ns, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS aggressor,
    l_extendedprice AS price, l_quantity AS quantity, l_orderkey AS trade_id
  FROM lineitem)"""


def raw_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a tape (seg, seq, t_ns, m, c): times floored to the hour, so that many tie."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seg"),
        F.col("event_id").alias("seq"),
        (F.floor(ns("ts") / F.lit(HOUR_NS)) * F.lit(HOUR_NS)).alias("t_ns"),
        F.when(F.col("event_type").isin("click", "purchase"), 0).otherwise(1).alias("m"),
        digitize(F.col("value"), MARK_EDGES).alias("c"),
    )


RAW_TAPE_SQL = """raw_tape AS (
  SELECT user_id AS seg, event_id AS seq, (epoch_us(ts) * 1000) // 3600000000000 * 3600000000000 AS t_ns,
    CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE 1 END AS m,
    (value >= 15)::INT + (value >= 35)::INT + (value >= 100)::INT AS c
  FROM events)"""


def state_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right-continuous state function (seg, t_ns, s): from each day on, the class of the previous day's imbalance."""
    days = raw_tape(spark, sf_dir).groupBy("seg", F.floor(F.col("t_ns") / F.lit(DAY_NS)).alias("day")).agg(F.avg(1 - 2 * F.col("m")).alias("imb"))
    return days.select("seg", ((F.col("day") + 1) * F.lit(DAY_NS)).alias("t_ns"), digitize(F.col("imb"), STATE_CUTS).alias("s"))


STEPS_SQL = (
    RAW_TAPE_SQL
    + """, state_steps AS (
  SELECT seg, (t_ns // 86400000000000 + 1) * 86400000000000 AS t_ns, (avg(1 - 2 * m) >= -0.2)::INT + (avg(1 - 2 * m) >= 0.2)::INT AS s
  FROM raw_tape GROUP BY seg, t_ns // 86400000000000)"""
)

TAPE_SQL = (
    STEPS_SQL
    + """, tape AS (
  SELECT r.seg, r.seq, r.t_ns, r.m, r.c, coalesce(s.s, 0) AS s, r.m + 2 * (coalesce(s.s, 0) + 3 * r.c) AS e
  FROM raw_tape r ASOF LEFT JOIN state_steps s ON r.seg = s.seg AND r.t_ns >= s.t_ns)"""
)


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as book level events (symbol, update, last_seq, side, price, quantity); quantity 0 deletes a level."""
    li = dealt(table(spark, sf_dir, "lineitem"), "l_suppkey")
    update = F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    pos = F.row_number().over(Window.partitionBy("l_suppkey", "l_shipdate").orderBy(*order))
    bid = F.col("l_linestatus") == "O"
    return li.select(
        F.col("l_suppkey").alias("symbol"), update.cast("long").alias("update"), ns("l_shipdate").alias("timestamp_ns"), pos.cast("long").alias("pos"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 1000 - F.col("l_partkey") % 50).otherwise(1001 + F.col("l_partkey") % 50).cast("double").alias("price"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("quantity"),
    )


LEVELS_SQL = """level_updates AS (
  SELECT l_suppkey AS symbol, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS update, epoch_us(l_shipdate) * 1000 AS timestamp_ns,
    row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS pos,
    CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
    (CASE WHEN l_linestatus = 'O' THEN 1000 - l_partkey % 50 ELSE 1001 + l_partkey % 50 END)::DOUBLE AS price,
    CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS quantity
  FROM lineitem)"""


def seq_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book updates with exchange sequence ranges, and a gap before every 97th update of a symbol."""
    per = level_updates(spark, sf_dir).groupBy("symbol", "update").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_ns").alias("timestamp_ns"))
    w = Window.partitionBy("symbol").orderBy("update").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("n").over(w) + 5 * F.floor(F.col("update") / 97)
    return per.select("symbol", F.col("update").alias("capture_seq"), "timestamp_ns", (last - F.col("n") + 1).alias("first_seq"), last.alias("last_seq"))


SEQ_SQL = (
    LEVELS_SQL
    + """, per_update AS (SELECT symbol, update, count(*) AS n, max(timestamp_ns) AS timestamp_ns FROM level_updates GROUP BY symbol, update),
  seq_updates AS (
  SELECT symbol, update AS capture_seq, timestamp_ns, last - n + 1 AS first_seq, last AS last_seq
  FROM (SELECT *, (sum(n) OVER (PARTITION BY symbol ORDER BY update) + 5 * (update // 97))::BIGINT AS last FROM per_update))"""
)
