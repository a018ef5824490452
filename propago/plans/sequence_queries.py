"""Queries over fills, updates and the tape with the ordered-sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propago.operators import sequence as q
from propago.plans.registry import query
from propago.sources import views as v

SYMBOL, SEG = ["symbol"], ["seg"]
DAY, HOUR = v.DAY_NS, v.HOUR_NS
#: Fills of a side up to three days apart are one order on the test tables, whose times are days.
MERGE_NS = 3 * DAY
WINDOWS = (6 * HOUR, DAY, 3 * DAY, 7 * DAY)


def tape(spark, sf_dir) -> DataFrame:
    return q.tape(v.raw_tape(spark, sf_dir), v.state_steps(spark, sf_dir)).select("seg", "seq", "t_ns", "m", "c", "s", "e")


def orders(spark, sf_dir, gap=MERGE_NS) -> DataFrame:
    return q.orders(v.fills(spark, sf_dir), SYMBOL, gap)


def _runs_sql(gap: int) -> str:
    return (
        v.FILLS_SQL
        + f""", flagged AS (
  SELECT *, coalesce(timestamp_ns - lag(timestamp_ns) OVER w > {gap}::BIGINT OR aggressor <> lag(aggressor) OVER w, true) AS new
  FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY capture_seq)
), numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY symbol ORDER BY capture_seq) AS run FROM flagged),
orders AS (
  SELECT symbol, run::BIGINT AS run, min(capture_seq) AS capture_seq, arg_min(timestamp_ns, capture_seq) AS timestamp_ns, arg_min(aggressor, capture_seq) AS aggressor,
    arg_min(trade_id, capture_seq) AS trade_id, arg_min(price, capture_seq) AS price_first, arg_max(price, capture_seq) AS price_last,
    sum(quantity) AS quantity, count(*) AS fills, count(DISTINCT price) AS levels
  FROM numbered GROUP BY symbol, run
)"""
    )


ORDERS_SQL = (
    _runs_sql(MERGE_NS)
    + """, timed AS (SELECT *, (timestamp_ns - first_value(timestamp_ns) OVER (PARTITION BY symbol ORDER BY run)) / 1e9 AS t, (aggressor = 'sell')::INT AS m FROM orders)"""
)
_ORDER_COLUMNS = "symbol, run, capture_seq, timestamp_ns, aggressor, trade_id, round(price_first, 4) AS price_first, round(price_last, 4) AS price_last, round(quantity, 4) AS quantity, fills, levels"


def _order_rows(df: DataFrame) -> DataFrame:
    rounded = [F.round(c, 4).alias(c) for c in ("price_first", "price_last", "quantity")]
    return df.select("symbol", "run", "capture_seq", "timestamp_ns", "aggressor", "trade_id", *rounded, "fills", "levels")


@query(_runs_sql(0) + f" SELECT {_ORDER_COLUMNS} FROM orders")
def collapse_exact(spark, sf_dir):
    return _order_rows(q.collapse(v.fills(spark, sf_dir), SYMBOL))


@query(_runs_sql(MERGE_NS) + f" SELECT {_ORDER_COLUMNS} FROM orders")
def collapse_tolerant(spark, sf_dir):
    return _order_rows(q.collapse(v.fills(spark, sf_dir), SYMBOL, merge_gap_ns=MERGE_NS))


@query(ORDERS_SQL + " SELECT symbol, run, round(t, 4) AS t, m FROM timed WHERE t < 200000 * 60.0")
def orders_load(spark, sf_dir):
    return q.orders(v.fills(spark, sf_dir), SYMBOL, MERGE_NS, minutes=200_000).select("symbol", "run", F.round("t", 4).alias("t"), "m")


@query(
    v.SEQ_SQL
    + """, gaps AS (SELECT *, first_seq - lag(last_seq) OVER (PARTITION BY symbol ORDER BY capture_seq) AS gap FROM seq_updates)
SELECT symbol, coalesce(bool_and(gap = 1), true) AS continuous, sum(coalesce((gap <> 1)::INT, 0))::BIGINT AS breaks, count(*) AS updates FROM gaps GROUP BY symbol"""
)
def continuity(spark, sf_dir):
    return q.continuity(v.seq_updates(spark, sf_dir), SYMBOL)


@query(
    v.SEQ_SQL
    + """, gaps AS (SELECT *, first_seq - lag(last_seq) OVER (PARTITION BY symbol ORDER BY capture_seq) AS gap FROM seq_updates),
marked AS (SELECT *, sum(coalesce((gap <> 1)::INT, 0)) OVER (PARTITION BY symbol ORDER BY capture_seq) AS segment FROM gaps)
SELECT symbol, segment::BIGINT AS segment, count(*) AS updates, min(first_seq) AS first_seq, max(last_seq) AS last_seq FROM marked GROUP BY symbol, segment"""
)
def segmentation(spark, sf_dir):
    return q.segments(v.seq_updates(spark, sf_dir), SYMBOL).groupBy("symbol", "segment").agg(F.count(F.lit(1)).alias("updates"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


@query(
    v.SEQ_SQL
    + """, seen AS (SELECT *, coalesce(max(last_seq) OVER (PARTITION BY symbol ORDER BY capture_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM seq_updates)
SELECT symbol, count(*) AS fresh FROM seen WHERE last_seq > greatest(seen, 100) GROUP BY symbol"""
)
def stale_update_filter(spark, sf_dir):
    return q.fresh_updates(v.seq_updates(spark, sf_dir), SYMBOL, 100).groupBy("symbol").agg(F.count(F.lit(1)).alias("fresh"))


@query(v.TAPE_SQL + " SELECT seg, seq, t_ns, m, c, s, e FROM tape")
def asof_state(spark, sf_dir):
    return tape(spark, sf_dir)


@query(
    v.TAPE_SQL
    + """, firsts AS (SELECT seg, arg_min(s, t_ns) AS first_s FROM state_steps GROUP BY seg)
SELECT r.seg, r.seq, coalesce(s.s, f.first_s, 0) AS s, r.m + 2 * (coalesce(s.s, f.first_s, 0) + 3 * r.c) AS e
FROM raw_tape r ASOF LEFT JOIN state_steps s ON r.seg = s.seg AND r.t_ns >= s.t_ns LEFT JOIN firsts f ON f.seg = r.seg"""
)
def backfilled_state(spark, sf_dir):
    """The tape under a state function whose first state also holds before its first step."""
    steps = q.backfilled(v.state_steps(spark, sf_dir), SEG, 0)
    return q.tape(v.raw_tape(spark, sf_dir), steps).select("seg", "seq", "s", "e")


@query(v.RAW_TAPE_SQL + " SELECT seg, seq, m + 2 * c AS e FROM raw_tape")
def exciting_type_without_state(spark, sf_dir):
    t = q.tape(v.raw_tape(spark, sf_dir), v.state_steps(spark, sf_dir), kernel_state=False)
    return t.select("seg", "seq", "e")


def _count_sql(mask: str, window: int) -> str:
    return f"(SELECT count(*) FROM tape x WHERE x.seg = t.seg AND {mask} AND x.t_ns > t.t_ns - {window}::BIGINT AND (x.t_ns < t.t_ns OR (x.t_ns = t.t_ns AND x.seq <= t.seq)))"


@query(v.TAPE_SQL + " SELECT seg, seq, " + ", ".join(f"{_count_sql(f'x.m = {k}', w)} AS n_m{k}_w{i}" for i, w in enumerate(WINDOWS[:3]) for k in (0, 1)) + " FROM tape t")
def trailing_counts(spark, sf_dir):
    add = {f"n_m{k}_w{i}": q.trailing_count(F.col("m") == k, w, SEG) for i, w in enumerate(WINDOWS[:3]) for k in (0, 1)}
    return tape(spark, sf_dir).withColumns(add).select("seg", "seq", *add)


@query(
    v.TAPE_SQL
    + " SELECT seg, seq, "
    + ", ".join(f"round(ln(1 + {_count_sql(f'x.m = {k}', w)}), 6) AS n_m{k}_w{i}" for i, w in enumerate((HOUR, DAY)) for k in (0, 1))
    + ", "
    + ", ".join(f"round(ln(1 + {_count_sql(f'x.m = {k} AND x.c = 3', DAY)}), 6) AS top_m{k}_w0" for k in (0, 1))
    + ", round(coalesce(ln((t_ns - lag(t_ns) OVER (PARTITION BY seg ORDER BY t_ns, seq)) / 1e9 + 0.0005), 0), 6) AS log_gap FROM tape t"
)
def summary_vector(spark, sf_dir):
    out = q.summaries(tape(spark, sf_dir), SEG, [HOUR, DAY], [DAY])
    return out.select("seg", "seq", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith(("n_m", "top_m", "log_gap"))))


_BEFORE = "x.seg = t.seg AND (x.t_ns < t.t_ns OR (x.t_ns = t.t_ns AND x.seq < t.seq))"


@query(
    v.TAPE_SQL
    + f""", covered AS (SELECT *, (SELECT count(*) FROM tape x WHERE {_BEFORE} AND x.t_ns >= t.t_ns - {6 * HOUR}::BIGINT) AS burst,
  (t_ns - (SELECT max(t_ns) FROM tape x WHERE {_BEFORE} AND x.m <> t.m)) / 1e9 AS opp_gap,
  lead(t_ns) OVER (PARTITION BY seg, m ORDER BY t_ns, seq) AS next_t_ns FROM tape t)
SELECT seg, seq, m, c, s, burst, round(opp_gap, 3) AS opp_gap, next_t_ns FROM covered WHERE next_t_ns IS NOT NULL"""
)
def opener_covariates(spark, sf_dir):
    return q.openers(tape(spark, sf_dir), SEG, 6 * HOUR).select("seg", "seq", "m", "c", "s", "burst", F.round("opp_gap", 3).alias("opp_gap"), "next_t_ns")


END_NS = 1_706_659_200_000_000_000  # 2024-01-31
START_NS = 1_704_067_200_000_000_000  # 2024-01-01
PIECES_SQL = (
    v.TAPE_SQL
    + f""", owned AS (SELECT seg, t_ns AS u0, coalesce(lead(t_ns) OVER w, {END_NS}) AS u1, row_number() OVER w - 1 AS k FROM tape WINDOW w AS (PARTITION BY seg ORDER BY t_ns, seq)),
points AS (SELECT seg, k, u1, u0 AS u FROM owned WHERE u1 > u0 UNION SELECT o.seg, k, u1, p.t_ns FROM owned o JOIN state_steps p ON o.seg = p.seg AND p.t_ns > o.u0 AND p.t_ns < o.u1),
bounded AS (SELECT seg, k, u AS u0_ns, coalesce(lead(u) OVER (PARTITION BY seg, k ORDER BY u), u1) AS u1_ns FROM points),
pieces AS (SELECT b.seg, k, u0_ns, u1_ns, coalesce(p.s, 0) AS s FROM bounded b ASOF LEFT JOIN state_steps p ON b.seg = p.seg AND b.u0_ns >= p.t_ns)"""
)


def pieces(spark, sf_dir) -> DataFrame:
    return q.split_intervals(tape(spark, sf_dir), v.state_steps(spark, sf_dir), SEG, END_NS)


@query(PIECES_SQL + " SELECT seg, k, u0_ns, u1_ns, s FROM pieces")
def interval_split(spark, sf_dir):
    return pieces(spark, sf_dir)


_A, _B, _BLOCK = START_NS + 5 * DAY, START_NS + 20 * DAY, 2 * DAY


@query(
    PIECES_SQL
    + f""", cut AS (SELECT seg, k, s, b AS block, greatest(u0_ns, {_A} + b * {_BLOCK}) AS u0_ns, least(u1_ns, {_B}, {_A} + (b + 1) * {_BLOCK}) AS u1_ns
  FROM pieces, (SELECT unnest(range(0, 8)) AS b))
SELECT seg, block, s, count(*) AS n, sum(u1_ns - u0_ns)::BIGINT AS exposure_ns FROM cut WHERE u1_ns > u0_ns GROUP BY seg, block, s"""
)
def clipped_pieces(spark, sf_dir):
    cut = q.clip_pieces(pieces(spark, sf_dir), _A, _B, _BLOCK)
    return cut.groupBy("seg", "block", "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("u1_ns") - F.col("u0_ns")).alias("exposure_ns"))


@query(
    v.STEPS_SQL
    + """, placed AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY seg) AS n FROM state_steps WINDOW w AS (PARTITION BY seg ORDER BY t_ns))
SELECT a.seg, a.t_ns, a.s, b.s AS shifted FROM placed a JOIN placed b ON a.seg = b.seg AND a.rn = (b.rn + 5) % b.n"""
)
def state_shift(spark, sf_dir):
    return q.circular_shift(v.state_steps(spark, sf_dir), SEG, ["t_ns"], "s", 5).select("seg", "t_ns", "s", "shifted")


@query(
    v.TAPE_SQL
    + """, drawn AS (SELECT *, row_number() OVER (PARTITION BY seg, m ORDER BY t_ns, seq) AS a, row_number() OVER (PARTITION BY seg, m ORDER BY md5(seq::VARCHAR), t_ns, seq) AS b FROM tape)
SELECT x.seg, x.seq, x.c, y.c AS shuffled FROM drawn x JOIN drawn y ON x.seg = y.seg AND x.m = y.m AND x.a = y.b"""
)
def mark_shuffle(spark, sf_dir):
    return q.grouped_shuffle(tape(spark, sf_dir), ["seg", "m"], ["t_ns", "seq"], "c", F.md5(F.col("seq").cast("string"))).select("seg", "seq", "c", "shuffled")


def _draw():
    return F.conv(F.substring(F.md5(F.col("seq").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


@query(
    v.RAW_TAPE_SQL
    + f""", drawn AS (SELECT *, floor(('0x' || md5(seq::VARCHAR)[1:8])::BIGINT / 4294967296.0 * {HOUR})::BIGINT AS u FROM raw_tape),
placed AS (SELECT *, row_number() OVER (PARTITION BY seg, t_ns ORDER BY seq) AS a, row_number() OVER (PARTITION BY seg, t_ns ORDER BY u, seq) AS b FROM drawn)
SELECT x.seg, x.seq, x.t_ns + y.u AS jittered_ns FROM placed x JOIN placed y ON x.seg = y.seg AND x.t_ns = y.t_ns AND x.a = y.b"""
)
def tick_jitter(spark, sf_dir):
    return q.jitter(v.raw_tape(spark, sf_dir), SEG, HOUR, _draw()).select("seg", "seq", "jittered_ns")


@query(
    v.TAPE_SQL
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY t_ns, seq) AS k FROM tape)
SELECT x.seg, x.seq, 8 - count(*) AS pad, sum(y.m)::BIGINT AS sides, sum(y.c)::BIGINT AS marks, round(max(ln((x.t_ns - y.t_ns) / 1e9 + 0.0005)), 6) AS oldest
FROM numbered x JOIN numbered y ON x.seg = y.seg AND y.k BETWEEN x.k - 7 AND x.k GROUP BY x.seg, x.seq"""
)
def token_windows(spark, sf_dir):
    out = q.token_window(tape(spark, sf_dir), SEG, 8)
    total = lambda f: F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return out.select("seg", "seq", F.col("pad").cast("long").alias("pad"), total("m").alias("sides"), total("c").alias("marks"), F.round(F.array_max(F.transform("tokens", lambda x: x["log_age"])), 6).alias("oldest"))


@query(
    v.RAW_TAPE_SQL
    + f""", floored AS (SELECT *, t_ns // {DAY} * {DAY} AS o FROM raw_tape),
flagged AS (SELECT *, coalesce(o <> lag(o) OVER w OR m <> lag(m) OVER w, true) AS new FROM floored WINDOW w AS (PARTITION BY seg ORDER BY t_ns, seq)),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY seg ORDER BY t_ns, seq) AS run FROM flagged)
SELECT seg, run::BIGINT AS run, min(o) AS t_ns, min(m) AS m, max(c) AS c, count(*) AS merged FROM numbered GROUP BY seg, run"""
)
def observed_tape(spark, sf_dir):
    return q.observe(v.raw_tape(spark, sf_dir), SEG, DAY).select("seg", "run", "t_ns", "m", "c", "merged")


@query(
    ORDERS_SQL
    + """, ended AS (SELECT *, max(t) OVER (PARTITION BY symbol) AS last_t FROM timed)
SELECT symbol, run, CASE WHEN t >= last_t * 0.7 AND t < last_t * 0.85 THEN 1 WHEN t >= last_t * 0.85 AND t < last_t THEN 2 ELSE 0 END AS split FROM ended"""
)
def split_ids(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("last_t", F.max("t").over(Window.partitionBy("symbol")))
    return o.select("symbol", "run", q.chronological_split(F.col("t"), F.col("last_t")).alias("split"))
