"""Summary and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from propago.operators import sequence as q
from propago.operators import summary as a
from propago.plans.registry import query
from propago.plans.sequence_queries import DAY, ORDERS_SQL, SEG, SYMBOL, orders, tape
from propago.sources import capture
from propago.sources import views as v

MARKS = (2, 3, 5)
MARK_SQL = "(fills >= 2)::INT + (fills >= 3)::INT + (fills >= 5)::INT"
WIDTH = 30 * 86400.0


def _rounded(df, names, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


@query(
    ORDERS_SQL
    + f""", gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY run) AS gap, {MARK_SQL} AS c FROM timed)
SELECT symbol, count(*) AS n, round(count(*) / nullif(max(t) - min(t), 0) * 86400, 6) AS per_day, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap) / nullif(avg(gap), 0), 6) AS cv,
  sum((c = 3)::INT)::BIGINT AS top_marks, sum(m)::BIGINT AS sells, round(sum(quantity), 4) AS quantity FROM gaps GROUP BY symbol"""
)
def orders_summary(spark, sf_dir):
    """Fills to orders to mark classes and gaps: the flagship, built-in functions only."""
    o = orders(spark, sf_dir).withColumns({"c": v.digitize(F.col("fills"), MARKS), "gap": F.col("t") - F.lag("t").over(Window.partitionBy("symbol").orderBy("run"))})
    return o.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.nullif(F.max("t") - F.min("t"), F.lit(0.0)) * 86400, 6).alias("per_day"), F.round(F.avg("gap"), 4).alias("mean_gap"),
        F.round(F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0)), 6).alias("cv"), F.sum((F.col("c") == 3).cast("int")).alias("top_marks"), F.sum("m").alias("sells"), F.round(F.sum("quantity"), 4).alias("quantity"),
    )


@query(
    ORDERS_SQL
    + """, gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY run) AS gap FROM timed)
SELECT symbol, count(*) AS n, round(count(*) / nullif(max(t) - min(t), 0), 9) AS rate, round(avg(gap), 4) AS mean_gap, round(median(gap), 4) AS median_gap, round(max(gap), 4) AS max_gap,
  round(avg((gap = 0)::INT), 6) AS zero_share, round(stddev_pop(gap) / nullif(avg(gap), 0), 6) AS cv FROM gaps GROUP BY symbol"""
)
def inter_arrival(spark, sf_dir):
    out = a.inter_arrival(orders(spark, sf_dir), SYMBOL)
    return _rounded(_rounded(_rounded(out, ("mean_gap", "median_gap", "max_gap"), 4), ("zero_share", "cv")), ("rate",), 9)


@query(
    ORDERS_SQL
    + f""", spans AS (SELECT symbol, t, min(t) OVER (PARTITION BY symbol) AS lo, max(t) OVER (PARTITION BY symbol) AS hi FROM timed),
binned AS (SELECT symbol, greatest(1, floor((hi - lo) / {WIDTH}))::BIGINT AS bins, t, lo, hi FROM spans),
counts AS (SELECT symbol, bins, coalesce(least(bins - 1, floor((t - lo) / nullif((hi - lo) / bins, 0))), 0)::BIGINT AS bin, count(*) AS n FROM binned GROUP BY ALL),
every AS (SELECT symbol, bins, unnest(range(0, bins)) AS bin FROM (SELECT DISTINCT symbol, bins FROM binned)),
filled AS (SELECT symbol, bins, coalesce(n, 0) AS n FROM every LEFT JOIN counts USING (symbol, bins, bin))
SELECT symbol, bins, round(avg(n), 6) AS mean, round(var_pop(n) / avg(n), 6) AS fano FROM filled GROUP BY symbol, bins"""
)
def fano_factor(spark, sf_dir):
    return _rounded(a.fano(orders(spark, sf_dir), SYMBOL, "t", WIDTH), ("mean", "fano"))


@query(v.FILLS_SQL + ", per AS (SELECT symbol, timestamp_ns, count(*) AS n FROM fills GROUP BY ALL) SELECT symbol, sum((n > 1)::INT)::BIGINT AS tied_times, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS tied_events FROM per GROUP BY symbol")
def tied_times(spark, sf_dir):
    return a.tied_times(v.fills(spark, sf_dir), SYMBOL, "timestamp_ns")


@query(v.TAPE_SQL + ", counts AS (SELECT s, c, count(*) AS n FROM tape GROUP BY s, c) SELECT s, c, n, round(n / sum(n) OVER (PARTITION BY s), 6) AS share FROM counts")
def mark_by_state(spark, sf_dir):
    return _rounded(a.class_shares(tape(spark, sf_dir), ["s"], "c"), ("share",))


@query(v.TAPE_SQL + ", counts AS (SELECT m, c, count(*) AS n FROM tape GROUP BY m, c) SELECT m, c, n, round(n / sum(n) OVER (PARTITION BY m), 6) AS share FROM counts")
def mark_by_side(spark, sf_dir):
    return _rounded(a.class_shares(tape(spark, sf_dir), ["m"], "c"), ("share",))


@query(
    ORDERS_SQL
    + f""", classed AS (SELECT {MARK_SQL} AS f, (levels >= 2)::INT + (levels >= 3)::INT + (levels >= 5)::INT AS l FROM orders)
SELECT f, sum((l = 0)::INT)::BIGINT AS n0, sum((l = 1)::INT)::BIGINT AS n1, sum((l = 2)::INT)::BIGINT AS n2, sum((l = 3)::INT)::BIGINT AS n3, count(*) AS n,
  round(avg((l = 0)::INT), 6) AS share0, round(avg((l = 1)::INT), 6) AS share1, round(avg((l = 2)::INT), 6) AS share2, round(avg((l = 3)::INT), 6) AS share3 FROM classed GROUP BY f"""
)
def fills_by_levels(spark, sf_dir):
    o = orders(spark, sf_dir).select(v.digitize(F.col("fills"), MARKS).alias("f"), v.digitize(F.col("levels"), MARKS).alias("l"))
    return _rounded(a.crosstab(o, "f", "l", 4), ("share0", "share1", "share2", "share3"))


@query(
    ORDERS_SQL
    + " SELECT round(corr(ln(fills), ln(levels)), 6) AS corr, round(quantile_cont(fills / levels, 0.5), 6) AS p50, round(quantile_cont(fills / levels, 0.9), 6) AS p90, count(DISTINCT symbol) AS symbols, round(quantile_cont(levels::DOUBLE, 0.9), 6) AS levels90, max(levels) AS levels_max FROM orders"
)
def fills_levels_association(spark, sf_dir):
    p = lambda c, k: F.round(F.percentile(c, F.lit(k)), 6)
    ratio = F.col("fills") / F.col("levels")
    return orders(spark, sf_dir).agg(
        F.round(F.corr(F.log("fills"), F.log("levels")), 6).alias("corr"), p(ratio, 0.5).alias("p50"), p(ratio, 0.9).alias("p90"), F.count_distinct("symbol").alias("symbols"), p(F.col("levels").cast("double"), 0.9).alias("levels90"), F.max("levels").alias("levels_max")
    )


_IMB_SQL = v.RAW_TAPE_SQL + f", days AS (SELECT seg, t_ns // {DAY} AS day, avg(1.0 - 2 * m) AS imb FROM raw_tape GROUP BY ALL)"


def _imbalance(spark, sf_dir):
    return v.raw_tape(spark, sf_dir).groupBy("seg", F.floor(F.col("t_ns") / F.lit(DAY)).alias("day")).agg(F.avg(1 - 2 * F.col("m")).alias("imb"))


@query(
    _IMB_SQL
    + """, cuts AS (SELECT seg, quantile_cont(imb, 0.3333333333333333::DOUBLE) AS lo, quantile_cont(imb, 0.6666666666666666::DOUBLE) AS hi FROM days WHERE day < 19744 GROUP BY seg)
SELECT seg, day, (imb >= lo - 1e-9)::INT + (imb >= hi - 1e-9)::INT AS state FROM days JOIN cuts USING (seg)"""
)
def tercile_states(spark, sf_dir):
    d = _imbalance(spark, sf_dir)
    cuts = a.tercile_cuts(d, SEG, "imb", F.col("day") < 19744).withColumn("cuts", F.transform("cuts", lambda x: x - 1e-9))
    return a.classify(d, cuts, SEG, "imb", "state").select("seg", "day", "state")


#: Gaps over their mean stand in for rescaled residuals.
_X_SQL = (
    v.TAPE_SQL
    + """, gaps AS (SELECT seg, m, s, c, seq, t_ns, (t_ns - lag(t_ns) OVER (PARTITION BY seg ORDER BY t_ns, seq)) / 3.6e12 AS gap FROM tape),
x AS (SELECT *, gap / avg(gap) OVER (PARTITION BY seg) AS x FROM gaps WHERE gap IS NOT NULL)"""
)


def scaled_gaps(spark, sf_dir):
    w = Window.partitionBy("seg").orderBy("t_ns", "seq")
    gaps = tape(spark, sf_dir).withColumn("gap", (F.col("t_ns") - F.lag("t_ns").over(w)) / 3.6e12).filter("gap IS NOT NULL")
    return gaps.withColumn("x", F.col("gap") / F.avg("gap").over(Window.partitionBy("seg")))


@query(
    _X_SQL
    + """, ranked AS (SELECT seg, x, row_number() OVER (PARTITION BY seg ORDER BY x) AS k, count(*) OVER (PARTITION BY seg) AS n FROM x)
SELECT seg, round(max(greatest(k / n - (1 - exp(-x)), 1 - exp(-x) - (k - 1) / n)), 6) AS ks, count(*) AS n FROM ranked GROUP BY seg"""
)
def ks_distance(spark, sf_dir):
    return _rounded(a.ks_exponential(scaled_gaps(spark, sf_dir), SEG, "x"), ("ks",))


@query(
    _X_SQL
    + """, centred AS (SELECT seg, t_ns, seq, x - avg(x) OVER (PARTITION BY seg) AS x FROM x),
lagged AS (SELECT *, """
    + ", ".join(f"x * lag(x, {h}) OVER w AS l{h}" for h in a.LAGS)
    + """ FROM centred WINDOW w AS (PARTITION BY seg ORDER BY t_ns, seq))
SELECT seg, """
    + ", ".join(f"round(sum(l{h}) / nullif(sum(x * x), 0), 6) AS acf{h}" for h in a.LAGS)
    + " FROM lagged GROUP BY seg"
)
def residual_autocorrelation(spark, sf_dir):
    return _rounded(a.autocorrelation(scaled_gaps(spark, sf_dir), SEG, "x", ["t_ns", "seq"]), tuple(f"acf{h}" for h in a.LAGS))


_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(
    _X_SQL
    + f", q AS (SELECT m, unnest({list(_PROBS)}::DOUBLE[]) AS p, unnest(quantile_cont(x, {list(_PROBS)}::DOUBLE[])) AS empirical FROM x GROUP BY m)"
    + " SELECT m, p, round(empirical, 6) AS empirical, round(-ln(1 - p), 6) AS exponential FROM q"
)
def residual_quantiles(spark, sf_dir):
    return _rounded(a.exponential_quantiles(scaled_gaps(spark, sf_dir), ["m"], "x", _PROBS), ("empirical", "exponential"))


@query(
    _X_SQL
    + """, binned AS (SELECT m, (c >= 1)::INT + (c >= 2)::INT + (c >= 3)::INT + (c >= 9)::INT AS bin, x FROM x),
found AS (SELECT m, bin, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n FROM binned GROUP BY ALL)
SELECT m, bin, round(mean, 6) AS mean, round(se, 6) AS se, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT m FROM x), (SELECT unnest(range(0, 5)) AS bin)) every LEFT JOIN found USING (m, bin)"""
)
def conditional_means(spark, sf_dir):
    out = _rounded(a.conditional_means(scaled_gaps(spark, sf_dir), ["m"], "x", "c", (1, 2, 3, 9)), ("mean", "se"))
    return out.withColumn("bin", F.col("bin").cast("long"))


@query(
    _X_SQL
    + """, binned AS (SELECT m, s, c, x FROM x), real AS (SELECT m, c AS bin, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n FROM binned WHERE s = 1 GROUP BY ALL),
nul AS (SELECT m, c AS bin, avg(x) AS mean FROM binned WHERE s <> 1 GROUP BY ALL)
SELECT m, coalesce(bool_and(CASE WHEN n >= 30 AND se IS NOT NULL AND nul.mean IS NOT NULL THEN abs(real.mean - nul.mean) <= 2 * se END), true) AS agrees,
  sum(CASE WHEN n >= 30 AND se IS NOT NULL AND nul.mean IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS compared FROM real JOIN nul USING (m, bin) GROUP BY m"""
)
def two_se_agreement(spark, sf_dir):
    x = scaled_gaps(spark, sf_dir)
    of = lambda df: a.conditional_means(df, ["m"], "x", "c", (1, 2, 3))
    return a.two_se_agreement(of(x.filter("s = 1")), of(x.filter("s <> 1")), ["m"])


_FACTS_SQL = (
    ORDERS_SQL.replace("fills AS (", "fills AS (", 1)
    + ", "
    + v.SEQ_SQL
    + """, gaps AS (SELECT symbol, first_seq - lag(last_seq) OVER (PARTITION BY symbol ORDER BY capture_seq) AS gap FROM seq_updates),
cont AS (SELECT symbol, coalesce(bool_and(gap = 1), true) AS continuous FROM gaps GROUP BY symbol),
facts AS (SELECT symbol, max(t) - min(t) AS span_s, count(*) AS orders, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM timed GROUP BY symbol)"""
)


@query(_FACTS_SQL + " SELECT symbol, round(span_s, 3) AS span_s, orders, first_ns, last_ns, continuous AND span_s >= 1000000 AND orders >= 100 AS eligible FROM facts JOIN cont USING (symbol)")
def session_eligibility(spark, sf_dir):
    out = a.eligibility(orders(spark, sf_dir), q.continuity(v.seq_updates(spark, sf_dir), SYMBOL).select("symbol", "continuous"), SYMBOL, 1_000_000, 100)
    return out.select("symbol", F.round("span_s", 3).alias("span_s"), "orders", "first_ns", "last_ns", "eligible")


#: Sessions are weeks of a series; even ones are registered, those of every fourth week make the batch.
_SESSION_SQL = (
    v.RAW_TAPE_SQL
    + f""", placed AS (SELECT *, t_ns // {7 * DAY} AS week, row_number() OVER (PARTITION BY seg, t_ns // {7 * DAY} ORDER BY t_ns, seq) AS place FROM raw_tape),
hashed AS (SELECT *, sha256(place || ':' || t_ns) AS h FROM placed),
sums AS (SELECT seg, week, min(t_ns) AS first_ns, max(t_ns) AS last_ns, count(*) AS n, sum(('0x' || h[1:12])::BIGINT)::HUGEINT AS a, sum(('0x' || h[13:24])::BIGINT)::HUGEINT AS b FROM hashed GROUP BY ALL),
sessions AS (SELECT seg AS symbol, week, first_ns, last_ns, (last_ns - first_ns) / 1e9 AS span_s, first_ns // {DAY} AS day, n >= 3 AS eligible, sha256(a || ':' || b || ':' || n)[1:16] AS fingerprint FROM sums),
registry AS (SELECT symbol, fingerprint, first_ns, last_ns, day FROM sessions WHERE week % 2 = 0),
batch AS (SELECT symbol, count(*) AS held, max(first_ns) AS latest FROM sessions WHERE week % 4 = 0 GROUP BY symbol),
joined AS (SELECT s.symbol, s.week, s.span_s, s.eligible, s.first_ns, coalesce(bool_or(s.fingerprint = r.fingerprint), false) AS same, coalesce(bool_or(s.first_ns < r.last_ns AND r.first_ns < s.last_ns), false) AS overlap, coalesce(bool_or(s.day = r.day), false) AS taken
  FROM sessions s LEFT JOIN registry r USING (symbol) GROUP BY s.symbol, s.week, s.span_s, s.eligible, s.first_ns)
SELECT j.symbol, week, concat_ws(';', CASE WHEN NOT eligible THEN 'not eligible' END, CASE WHEN span_s < 86400 * 3 THEN 'short span' END, CASE WHEN coalesce(held, 0) >= 2 THEN 'batch full' END, CASE WHEN same THEN 'same data' END,
  CASE WHEN overlap THEN 'overlaps' END, CASE WHEN taken THEN 'date taken' END, CASE WHEN first_ns <= latest THEN 'capture order' END) AS reasons FROM joined j LEFT JOIN batch b ON b.symbol = j.symbol"""
)


@query(_SESSION_SQL)
def session_admission(spark, sf_dir):
    raw = v.raw_tape(spark, sf_dir).withColumn("week", F.floor(F.col("t_ns") / F.lit(7 * DAY))).withColumnRenamed("seg", "symbol")
    facts = raw.groupBy("symbol", "week").agg(
        F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"), ((F.max("t_ns") - F.min("t_ns")) / 1e9).alias("span_s"), F.floor(F.min("t_ns") / F.lit(DAY)).alias("day"), (F.count(F.lit(1)) >= 3).alias("eligible")
    )
    sessions = facts.join(capture.fingerprint(raw, ["symbol", "week"], "t_ns", ["t_ns", "seq"]), ["symbol", "week"])
    out = a.admission(sessions, sessions.filter("week % 2 = 0"), 86400 * 3, sessions.filter("week % 4 = 0"), 2)
    return out.select("symbol", "week", F.array_join("reasons", ";").alias("reasons"))
