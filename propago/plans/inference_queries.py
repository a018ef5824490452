"""Uncertainty, control and verdict queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from propago.operators import inference as x
from propago.operators import sequence as q
from propago.plans.hawkes_queries import A_NS, B_NS, DAY
from propago.plans.registry import query
from propago.plans.sequence_queries import tape
from propago.sources import views as v

RESAMPLES = 2_000
#: Two Poisson models compared by day: one rate a type against one rate a type and state, both from the whole tape.
_GAIN_SQL = (
    v.TAPE_SQL
    + f""", inside AS (SELECT *, (t_ns - {A_NS}) // {DAY} AS block FROM tape WHERE t_ns >= {A_NS} AND t_ns < {B_NS}),
plain AS (SELECT m, count(*) / (SELECT count(*) FROM inside) AS p FROM inside GROUP BY m),
marked AS (SELECT m, s, count(*) / sum(count(*)) OVER (PARTITION BY s) AS p FROM inside GROUP BY m, s),
blocks AS (SELECT m % 1 AS g, block, sum(ln(marked.p) - ln(plain.p)) AS gain, count(*) AS events FROM inside JOIN plain USING (m) JOIN marked USING (m, s) GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM blocks),
draws AS (SELECT g, r, ('0x' || md5(r || ':' || i)[1:8])::BIGINT % n AS i FROM numbered, (SELECT unnest(range(0, {RESAMPLES})) AS r)),
each AS (SELECT g, r, sum(gain) / sum(events) AS x FROM draws JOIN numbered USING (g, i) GROUP BY g, r)"""
)


def gain_blocks(spark, sf_dir):
    inside = tape(spark, sf_dir).filter((F.col("t_ns") >= A_NS) & (F.col("t_ns") < B_NS)).withColumn("block", F.floor((F.col("t_ns") - A_NS) / F.lit(DAY)))
    counts = inside.groupBy("block", "m", "s").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    # Class counts by block are few; all windows below are over them.
    logs = counts.withColumn("g", F.lit(0)).withColumns({"plain": F.log(total("g", "m") / total("g")), "marked": F.log(total("m", "s") / total("g", "s"))})
    blocks = logs.groupBy("g", "block")
    return x.paired_blocks(blocks.agg(F.sum(F.col("n") * F.col("plain")).alias("loglik"), F.sum("n").alias("events")), blocks.agg(F.sum(F.col("n") * F.col("marked")).alias("loglik")), ["g", "block"])


def _interval(df):
    return df.select(*(c for c in df.columns if c not in ("estimate", "low", "high")), *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")))


@query(_GAIN_SQL + " SELECT block, round(gain, 6) AS gain, events FROM blocks")
def model_gain_blocks(spark, sf_dir):
    return gain_blocks(spark, sf_dir).select("block", F.round("gain", 6).alias("gain"), "events")


@query(_GAIN_SQL + " SELECT 0 AS g, round((SELECT sum(gain) / sum(events) FROM blocks), 6) AS estimate, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, CASE WHEN quantile_cont(x, 0.025) > 0 THEN 'supported' WHEN quantile_cont(x, 0.975) < 0 THEN 'refuted' ELSE 'open' END AS verdict FROM each")
def bootstrap_gain(spark, sf_dir):
    return _interval(x.verdicts(x.block_bootstrap(gain_blocks(spark, sf_dir), ["g"], RESAMPLES)))


@query(
    _GAIN_SQL
    + f""", sized AS (SELECT factor, block // factor AS block, sum(gain) AS gain, sum(events) AS events FROM blocks, (SELECT unnest([1, 2, 5]) AS factor) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY factor) AS n FROM sized),
taken AS (SELECT factor, r, ('0x' || md5(r || ':' || i)[1:8])::BIGINT % n AS i FROM placed, (SELECT unnest(range(0, {RESAMPLES})) AS r)),
drawn AS (SELECT factor, r, sum(gain) / sum(events) AS x FROM taken JOIN placed USING (factor, i) GROUP BY factor, r)
SELECT 0 AS g, factor, round((SELECT sum(gain) / sum(events) FROM blocks), 6) AS estimate, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM drawn GROUP BY factor"""
)
def bootstrap_block_sizes(spark, sf_dir):
    """The interval at blocks of one, two and five days."""
    return _interval(x.block_bootstrap(x.coarser(gain_blocks(spark, sf_dir), ["g"], [1, 2, 5]), ["g", "factor"], RESAMPLES))


@query(
    v.TAPE_SQL
    + """, rates AS (SELECT m, s, c, avg(ln(1 + c + s)) AS nll FROM tape GROUP BY m, s, c), named AS (SELECT m, 's' || s || 'c' || c AS model, nll FROM rates)
SELECT m, arg_min(model, (nll, model)) AS model, round(min(nll), 6) AS nll FROM named GROUP BY m"""
)
def reference_model(spark, sf_dir):
    """The comparator: the lowest score among named models, ties to the first name."""
    scores = tape(spark, sf_dir).groupBy("m", F.concat(F.lit("s"), "s", F.lit("c"), "c").alias("model")).agg(F.avg(F.log1p(F.col("c") + F.col("s"))).alias("nll"))
    return x.best_model(scores, ["m"]).withColumn("nll", F.round("nll", 6))


@query(v.TAPE_SQL + ", runs AS (SELECT m, seg % 5 AS seed, avg(c) AS nll FROM tape GROUP BY ALL) SELECT m, round(avg(nll), 6) AS mean, round(stddev_samp(nll), 6) AS sd, count(*) AS runs FROM runs GROUP BY m")
def seed_spread(spark, sf_dir):
    scores = tape(spark, sf_dir).groupBy("m", (F.col("seg") % 5).alias("seed")).agg(F.avg("c").alias("nll"))
    return x.seed_spread(scores, ["m"]).select("m", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "runs")


@query(
    v.TAPE_SQL
    + """, share AS (SELECT m, s, avg((c >= 2)::INT) AS top FROM tape GROUP BY m, s), steps AS (SELECT m, top - lag(top) OVER (PARTITION BY m ORDER BY s) AS step FROM share)
SELECT m, coalesce(bool_and(step > 0), true) AS rises, coalesce(bool_and(step < 0), true) AS falls FROM steps GROUP BY m"""
)
def monotone_over_states(spark, sf_dir):
    share = tape(spark, sf_dir).groupBy("m", "s").agg(F.avg((F.col("c") >= 2).cast("int")).alias("top"))
    return x.strictly_monotone(share, ["m"], "s", "top")


@query(
    v.TAPE_SQL
    + f""", split AS (SELECT *, (t_ns >= {A_NS})::INT AS part FROM tape),
drawn AS (SELECT *, row_number() OVER (PARTITION BY seg, part, m ORDER BY t_ns, seq) AS a, row_number() OVER (PARTITION BY seg, part, m ORDER BY md5(seq || ':1'), t_ns, seq) AS b FROM split),
shuffled AS (SELECT x.part, x.m, x.s, x.c, y.c AS shuffled FROM drawn x JOIN drawn y ON x.seg = y.seg AND x.part = y.part AND x.m = y.m AND x.a = y.b)
SELECT part, s, round(avg(c), 6) AS mean_mark, round(avg(shuffled), 6) AS mean_shuffled, count(*) AS n FROM shuffled GROUP BY part, s"""
)
def shuffled_mark_control(spark, sf_dir):
    split = tape(spark, sf_dir).withColumn("part", (F.col("t_ns") >= A_NS).cast("int"))
    out = q.grouped_shuffle(split, ["seg", "part", "m"], ["t_ns", "seq"], "c", F.md5(F.concat("seq", F.lit(":1"))))
    return out.groupBy("part", "s").agg(F.round(F.avg("c"), 6).alias("mean_mark"), F.round(F.avg("shuffled"), 6).alias("mean_shuffled"), F.count(F.lit(1)).alias("n"))
