"""Point-process queries. Times are in hours; the model's parameters follow simple rules that the twins repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from propago.operators import fits, inference
from propago.operators import hawkes as h
from propago.operators import ladder
from propago.operators import sequence as q
from propago.operators import summary as a
from propago.plans.registry import query
from propago.plans.sequence_queries import DAY, END_NS, PIECES_SQL, SEG, START_NS, SYMBOL, pieces, tape
from propago.session import cut, union
from propago.sources import views as v

HOUR = v.HOUR_NS
HALF_LIVES = (6.0, 24.0, 120.0)
BETA = tuple(float(np.log(2) / x) for x in HALF_LIVES)
S, K, J = 3, 2, 24
A_NS, B_NS = START_NS + 5 * DAY, START_NS + 25 * DAY
BLOCK_NS = 5 * DAY

MODEL = h.model(
    [[0.02 + 0.01 * s + 0.005 * k for k in range(K)] for s in range(S)],
    [[[0.001 / (1 + n) * (2 if j % 2 == k else 1) * (1 + j // 6) for j in range(J)] for k in range(K)] for n in range(len(BETA))],
    BETA,
    HOUR,
)
_MU = "(0.02 + 0.01 * {s} + 0.005 * {k})"
_ALPHA = "(0.001 / (1 + l) * CASE WHEN {e} % 2 = {k} THEN 2 ELSE 1 END * (1 + {e} // 6))"
_SCALES = f"scales AS (SELECT unnest([0, 1, 2]) AS l, unnest({list(BETA)}::DOUBLE[]) AS beta)"

EXCITED_SQL = (
    PIECES_SQL
    + f""", {_SCALES},
pairs AS (SELECT t.seg, t.seq, t.t_ns, t.m, t.s, x.e AS e0, l, beta, exp(-beta * (t.t_ns - x.t_ns) / 3.6e12) AS decay FROM tape t JOIN tape x ON x.seg = t.seg AND (x.t_ns < t.t_ns OR (x.t_ns = t.t_ns AND x.seq < t.seq)), scales),
rates AS (SELECT t.seg, t.seq, t.t_ns, t.m, {_MU.format(s="t.s", k="t.m")} + coalesce(kick, 0) AS intensity FROM tape t
  LEFT JOIN (SELECT seg, seq, sum({_ALPHA.format(e="e0", k="m")} * decay) AS kick FROM pairs GROUP BY ALL) USING (seg, seq)),
kinds AS (SELECT unnest([0, 1]) AS k),
kicks AS (SELECT seg, k, sum({_ALPHA.format(e="e", k="k")} / beta * (exp(-beta * greatest(0, ({A_NS} - t_ns) / 3.6e12)) - exp(-beta * greatest(0, ({B_NS} - t_ns) / 3.6e12)))) AS kick
  FROM tape, scales, kinds WHERE t_ns < {B_NS} GROUP BY ALL),
cells AS (SELECT seg, coalesce(s, 0) AS s, greatest(t_ns, {A_NS}) AS u0, least(coalesce(lead(t_ns) OVER (PARTITION BY seg ORDER BY t_ns, s NULLS LAST), {B_NS}), {B_NS}) AS u1
  FROM (SELECT seg, t_ns, s FROM state_steps WHERE t_ns < {B_NS} UNION ALL SELECT DISTINCT seg, {START_NS} - {DAY} AS t_ns, NULL AS s FROM tape)),
bases AS (SELECT seg, k, sum({_MU.format(s="s", k="k")} * (u1 - u0) / 3.6e12) AS base FROM cells, kinds WHERE u1 > u0 GROUP BY ALL),
areas AS (SELECT b.seg, b.k AS m, base + coalesce(kick, 0) AS compensator FROM bases b LEFT JOIN kicks USING (seg, k))"""
)


def excited(spark, sf_dir, chunk_ns=None):
    return h.excitation(tape(spark, sf_dir), SEG, BETA, J, HOUR, chunk_ns)


def cells(spark, sf_dir, block_ns=None):
    t = tape(spark, sf_dir)
    return h.state_pieces(v.state_steps(spark, sf_dir), t, SEG, A_NS, B_NS, block_ns)


_R_SQL = EXCITED_SQL + """, sums AS (SELECT seg, seq, round(sum(CASE WHEN l = 0 THEN decay ELSE 0 END), 6) AS fast, round(sum(CASE WHEN l = 2 AND e0 % 2 = 1 THEN decay ELSE 0 END), 6) AS slow_sell FROM pairs GROUP BY ALL)
SELECT t.seg, t.seq, coalesce(fast, 0) AS fast, coalesce(slow_sell, 0) AS slow_sell FROM tape t LEFT JOIN sums USING (seg, seq)"""


def _decayed(df):
    at = lambda ks: F.round(sum((F.get("R", k) for k in ks), F.lit(0.0)), 6)
    return df.select("seg", "seq", at(range(J)).alias("fast"), at(range(2 * J + 1, 3 * J, 2)).alias("slow_sell"))


@query(_R_SQL)
def excitation(spark, sf_dir):
    return _decayed(excited(spark, sf_dir))


@query(_R_SQL)
def excitation_chunked(spark, sf_dir):
    """The same by chunks of a series that run in parallel."""
    return _decayed(excited(spark, sf_dir, chunk_ns=4 * DAY))


@query(EXCITED_SQL + " SELECT seg, seq, m, round(intensity, 6) AS intensity FROM rates")
def intensity(spark, sf_dir):
    return h.intensity(excited(spark, sf_dir), MODEL).select("seg", "seq", "m", F.round("intensity", 6).alias("intensity"))


@query(EXCITED_SQL + " SELECT seg, m, round(compensator, 5) AS compensator FROM areas")
def compensator(spark, sf_dir):
    return h.compensator(tape(spark, sf_dir), cells(spark, sf_dir), MODEL, SEG, A_NS, B_NS).select("seg", "m", F.round("compensator", 5).alias("compensator"))


@query(
    EXCITED_SQL
    + f""", logs AS (SELECT seg, sum(ln(intensity)) AS points, count(*) AS events FROM rates WHERE t_ns >= {A_NS} AND t_ns < {B_NS} GROUP BY seg)
SELECT seg, coalesce(events, 0) AS events, round(coalesce(points, 0) - area, 4) AS loglik FROM (SELECT seg, sum(compensator) AS area FROM areas GROUP BY seg) LEFT JOIN logs USING (seg)"""
)
def log_likelihood(spark, sf_dir):
    return h.log_likelihood(excited(spark, sf_dir), cells(spark, sf_dir), MODEL, SEG, A_NS, B_NS, tape(spark, sf_dir)).withColumn("loglik", F.round("loglik", 4))


_CELLS_SQL = (
    EXCITED_SQL
    + f""", blocked AS (SELECT seg, b AS block, s, greatest(u0, {A_NS} + b * {BLOCK_NS}) AS u0, least(u1, {A_NS} + (b + 1) * {BLOCK_NS}) AS u1 FROM cells, (SELECT unnest(range(0, 4)) AS b))"""
)


@query(_CELLS_SQL + " SELECT seg, block, s, round(sum(u1 - u0) / 3.6e12, 6) AS exposure FROM blocked WHERE u1 > u0 GROUP BY ALL")
def state_exposure(spark, sf_dir):
    return h.exposure(cells(spark, sf_dir, BLOCK_NS), SEG, HOUR).withColumn("exposure", F.round("exposure", 6))


@query(
    _CELLS_SQL
    + f""", time AS (SELECT block, s, sum(u1 - u0) / 3.6e12 AS exposure FROM blocked WHERE u1 > u0 GROUP BY ALL),
counts AS (SELECT (t_ns - {A_NS}) // {BLOCK_NS} AS block, s, m, count(*) AS n FROM tape WHERE t_ns >= {A_NS} AND t_ns < {B_NS} GROUP BY ALL)
SELECT block, s, k AS m, coalesce(n, 0) AS n, round(coalesce(n / nullif(exposure, 0), 0), 6) AS rate FROM (SELECT * FROM time, kinds) x LEFT JOIN counts c USING (block, s) WHERE c.m IS NULL OR c.m = k"""
)
def poisson_mle(spark, sf_dir):
    out = h.poisson_rates(tape(spark, sf_dir), cells(spark, sf_dir, BLOCK_NS), A_NS, B_NS, HOUR, K, BLOCK_NS)
    return out.select("block", "s", "m", "n", F.round("rate", 6).alias("rate"))


_AREA_SQL = (
    EXCITED_SQL
    + f""", owned_mu AS (SELECT seg, pieces.k AS idx, kk.k AS m, sum({_MU.format(s="s", k="kk.k")} * (u1_ns - u0_ns) / 3.6e12) AS base FROM pieces, kinds kk GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY t_ns, seq) - 1 AS idx FROM tape),
flat AS (SELECT n.seg, n.seq, n.m, sum(o.base) AS base FROM numbered n JOIN owned_mu o ON o.seg = n.seg AND o.m = n.m AND o.idx < n.idx GROUP BY ALL),
kicked AS (SELECT seg, seq, sum({_ALPHA.format(e="e0", k="m")} / beta * (1 - decay)) AS kick FROM pairs GROUP BY ALL),
total AS (SELECT n.seg, n.seq, n.t_ns, n.m, coalesce(base, 0) + coalesce(kick, 0) AS area FROM numbered n LEFT JOIN flat USING (seg, seq) LEFT JOIN kicked USING (seg, seq)),
residuals AS (SELECT *, area - lag(area) OVER (PARTITION BY seg, m ORDER BY t_ns, seq) AS residual FROM total)"""
)


def residuals(spark, sf_dir):
    kicked = h.excitation(tape(spark, sf_dir), SEG, BETA, J, HOUR, dots=MODEL)
    return h.rescaled_residuals(kicked, pieces(spark, sf_dir), MODEL, SEG)


@query(_AREA_SQL + " SELECT seg, seq, m, round(residual, 5) AS residual FROM residuals WHERE residual IS NOT NULL")
def rescaled_residuals(spark, sf_dir):
    return residuals(spark, sf_dir).select("seg", "seq", "m", F.round("residual", 5).alias("residual"))


@query(
    _AREA_SQL
    + """, ranked AS (SELECT m, residual AS x, row_number() OVER (PARTITION BY m ORDER BY residual) AS k, count(*) OVER (PARTITION BY m) AS n FROM residuals WHERE residual IS NOT NULL)
SELECT m, round(max(greatest(k / n - (1 - exp(-x)), 1 - exp(-x) - (k - 1) / n)), 5) AS ks, count(*) AS n FROM ranked GROUP BY m"""
)
def residual_ks(spark, sf_dir):
    return a.ks_exponential(residuals(spark, sf_dir), ["m"], "residual", large=True).withColumn("ks", F.round("ks", 5))


def block_loglik_rows(spark, sf_dir, m):
    return h.block_log_likelihood(tape(spark, sf_dir), v.state_steps(spark, sf_dir), m, SEG, A_NS, B_NS, BLOCK_NS, END_NS)


@query(
    _CELLS_SQL
    + f""", block_ids AS (SELECT unnest(range(0, 4)) AS block),
bk AS (SELECT block, sum({_ALPHA.format(e="e", k="k")} / beta * (exp(-beta * greatest(0, ({A_NS} + block * {BLOCK_NS} - t_ns) / 3.6e12)) - exp(-beta * greatest(0, ({A_NS} + (block + 1) * {BLOCK_NS} - t_ns) / 3.6e12)))) AS kick
  FROM tape, scales, kinds, block_ids WHERE t_ns < {A_NS} + (block + 1) * {BLOCK_NS} GROUP BY ALL),
bb AS (SELECT block, sum({_MU.format(s="s", k="k")} * (u1 - u0) / 3.6e12) AS base FROM blocked, kinds WHERE u1 > u0 AND seg IN (SELECT seg FROM tape) GROUP BY ALL),
bp AS (SELECT (t_ns - {A_NS}) // {BLOCK_NS} AS block, sum(ln(intensity)) AS points, count(*) AS events FROM rates WHERE t_ns >= {A_NS} AND t_ns < {B_NS} GROUP BY ALL)
SELECT block, coalesce(events, 0) AS events, round(coalesce(points, 0) - base - coalesce(kick, 0), 2) AS loglik FROM bb LEFT JOIN bk USING (block) LEFT JOIN bp USING (block)"""
)
def block_loglik(spark, sf_dir):
    return block_loglik_rows(spark, sf_dir, MODEL).withColumn("loglik", F.round("loglik", 2))


_FIT = f"t_ns >= {A_NS} AND t_ns < {B_NS}"


def _em_sql(step: int) -> str:
    """One step: the value under the last parameters, and the parameters under which the expected events are likeliest."""
    p = step - 1
    return f""", lam{p} AS (SELECT i.seg, i.seq, i.m, i.s, mu.v + coalesce(k.kick, 0) AS lam, mu.v AS base FROM inside i JOIN mu{p} mu ON mu.s = i.s AND mu.m = i.m
  LEFT JOIN (SELECT seg, seq, sum(decay * v) AS kick FROM near JOIN alpha{p} USING (l, m, e0) GROUP BY ALL) k USING (seg, seq)),
value{p} AS (SELECT {p} AS step, (SELECT sum(ln(lam)) FROM lam{p}) - (SELECT sum(v * x) FROM mu{p} JOIN time USING (s)) - (SELECT sum(v * x) FROM alpha{p} JOIN mass USING (l, e0)) AS loglik),
mu{step} AS (SELECT mu.s, mu.m, coalesce(b.x, 0) / t.x AS v FROM mu{p} mu JOIN time t USING (s) LEFT JOIN (SELECT s, m, sum(base / lam) AS x FROM lam{p} GROUP BY ALL) b USING (s, m)),
alpha{step} AS (SELECT l, m, e0, coalesce(n.x, 0) / mass.x AS v FROM alpha{p} JOIN mass USING (l, e0) LEFT JOIN (SELECT l, near.m, e0, sum(decay * v / lam) AS x FROM near JOIN alpha{p} USING (l, m, e0) JOIN lam{p} USING (seg, seq) GROUP BY ALL) n USING (l, m, e0))"""


_EM_SQL = (
    EXCITED_SQL
    + f""", inside AS (SELECT * FROM tape WHERE {_FIT}), near AS (SELECT seg, seq, m, e0, l, sum(decay) AS decay FROM pairs WHERE {_FIT} GROUP BY ALL),
time AS (SELECT s, sum(u1 - u0) / 3.6e12 AS x FROM cells WHERE u1 > u0 GROUP BY s),
mass AS (SELECT l, e AS e0, sum(exp(-beta * greatest(0, ({A_NS} - t_ns) / 3.6e12)) - exp(-beta * greatest(0, ({B_NS} - t_ns) / 3.6e12))) / any_value(beta) AS x FROM tape, scales WHERE t_ns < {B_NS} GROUP BY ALL),
counts AS (SELECT m, count(*) AS n FROM inside GROUP BY m),
mu0 AS (SELECT s, m, n / (SELECT sum(x) FROM time) / 2 AS v FROM time, counts),
alpha0 AS (SELECT l, m, e0, n / ({len(BETA)} * {J} * greatest(x, 1e-9)) / 2 AS v FROM mass, counts)"""
    + "".join(_em_sql(k) for k in (1, 2, 3))
)


@query(_EM_SQL + " SELECT l::INT AS scale, m::INT AS m, e0::INT AS e, round(ln(2) / beta, 6) AS half_life, round(v / beta, 7) AS branching FROM alpha3 JOIN scales USING (l)")
def em_branching(spark, sf_dir):
    """Branching by scale, type and exciting type, and half-lives, of the marked, state-dependent model after three steps
    of expectation-maximisation on the tape."""
    like = h.Likelihood(excited(spark, sf_dir), cells(spark, sf_dir), (S, K, len(BETA), J), BETA, A_NS, B_NS, HOUR, tape=tape(spark, sf_dir))
    mu, alpha = like.start()
    for _ in range(3):
        _, births, parents = like.at([(mu, alpha)])[0]
        mu, alpha = like.step(births, parents)
    m = like.as_model(mu, alpha)
    by_scale, lives = m.branching_by_scale(), m.half_lives()
    rows = [(n, i, j, round(float(lives[n]), 6), round(float(by_scale[n, i, j]), 7)) for n in range(len(BETA)) for i in range(K) for j in range(J) if like.mass[n, j] > 0]
    return spark.createDataFrame(rows, "scale int, m int, e int, half_life double, branching double")


_EM_STEPS_SQL = (
    _EM_SQL
    + " SELECT step, round(loglik, 2) AS loglik FROM (SELECT * FROM value0 UNION ALL SELECT * FROM value1 UNION ALL SELECT * FROM value2)"
)


@query(_EM_STEPS_SQL)
def hawkes_em_steps(spark, sf_dir):
    """The log-likelihood of the marked, state-dependent model before each of three steps of expectation-maximisation."""
    like = h.Likelihood(excited(spark, sf_dir), cells(spark, sf_dir), (S, K, len(BETA), J), BETA, A_NS, B_NS, HOUR, tape=tape(spark, sf_dir))
    return spark.createDataFrame([(i, round(x, 2)) for i, x in enumerate(h.em_trace(like, 3))], "step int, loglik double")


@query()
def hawkes_fit(spark, sf_dir):
    """Pooled fit of the marked, state-dependent model to convergence; one row a step with its log-likelihood."""
    _, trace = h.fit_pooled(excited(spark, sf_dir), cells(spark, sf_dir), (S, K, len(BETA), J), BETA, A_NS, B_NS, HOUR, tolerance=1e-7, tape=tape(spark, sf_dir))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(trace)], "step int, loglik double")


_DEC_SQL = EXCITED_SQL + f""", seen AS (SELECT seg, m, count(*) AS observed FROM tape WHERE t_ns >= {A_NS} AND t_ns < {B_NS} GROUP BY ALL)
SELECT b.seg, b.k AS m, coalesce(observed, 0) AS observed, round(base, 5) AS baseline, round(coalesce(kick, 0), 5) AS excited FROM bases b LEFT JOIN kicks USING (seg, k) LEFT JOIN seen ON seen.seg = b.seg AND seen.m = b.k"""


@query(_DEC_SQL)
def count_decomposition(spark, sf_dir):
    out = ladder.decomposition(tape(spark, sf_dir), cells(spark, sf_dir), MODEL, SEG, A_NS, B_NS)
    return out.select("seg", "m", "observed", F.round("baseline", 5).alias("baseline"), F.round("excited", 5).alias("excited"))


CUT_NS = A_NS + 14 * DAY


# The ladder of named models, its controls and verdicts, over one shared excitation

SLOW, DENSE = (*HALF_LIVES, 480.0), (3.0, 6.0, 12.0, 24.0, 48.0, 120.0)
BLOCKS = (A_NS + 7 * DAY,)
SHUFFLES, SHIFTS = (1, 2, 3), (1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6)
#: Days of the validation part, and blocks of so many for intervals.
BLOCK_SIZES = (1, 2, 3)
STARTS = [CUT_NS + k * DAY for k in range((B_NS - CUT_NS) // DAY + 1)]


def rates(half_lives) -> tuple[float, ...]:
    return tuple(float(np.log(2) / x) for x in half_lives)


def named(edges=BLOCKS) -> dict[str, fits.Spec]:
    """The models: Poisson, Hawkes, with marks, with states, with both, with both but states in the baseline only; then
    slow scales, a dense grid, both, and slow scales on one block of the baseline."""
    full = {"kernel_state": True, "kernel_mark": True, "edges": edges}
    models = [
        fits.Spec("M0", baseline_state=False, edges=edges), fits.Spec("M1", BETA, baseline_state=False, edges=edges), fits.Spec("M2", BETA, baseline_state=False, kernel_mark=True, edges=edges),
        fits.Spec("M3", BETA, kernel_state=True, edges=edges), fits.Spec("M4", BETA, **full), fits.Spec("M4nok", BETA, kernel_mark=True, edges=edges), fits.Spec("E1", rates(SLOW), **full),
        fits.Spec("E2", rates(DENSE), **full), fits.Spec("E1+E2", rates((*DENSE, 480.0)), **full), fits.Spec("E1'", rates(SLOW), kernel_state=True, kernel_mark=True),
    ]
    return {s.name: s for s in models}


def shared_rows(spark, sf_dir, specs, starts, seeds=(), shares=(), split=CUT_NS, end=B_NS):
    """The rows that fits and scores share: one excitation over all tapes and scales that the models need."""
    tapes, steps = fits.control_tapes(tape(spark, sf_dir), v.state_steps(spark, sf_dir), SEG, [split], seeds, shares)
    scales = {b for s in specs for b in (s.scales or BETA[:1])}
    return fits.share(tapes, steps, SEG, scales, K, S, 4, HOUR, end, tuple(starts))


def comparators(spark, sf_dir, a_ns, b_ns, starts, end=B_NS):
    """Shared rows with edges at ``starts``, and the models that a neural one is compared with, fitted on [a, b)."""
    specs = [named()[name] for name in ("M1", "M4", "E1'")]
    shared = shared_rows(spark, sf_dir, specs, starts, split=b_ns, end=end)
    return shared, fits.fit_all(shared, specs, a_ns, b_ns, tolerance=1e-6)


def _gains(scores, pairs):
    """(gain, block, events) rows by pair, from block scores by model."""
    out = None
    for other, reference in pairs:
        of = lambda name: scores.filter(F.col("name") == name).select("block", "loglik", "events")
        rows = inference.paired_blocks(of(reference), of(other), ["block"]).withColumns({"model": F.lit(other), "reference": F.lit(reference)})
        out = rows if out is None else union(out, rows)
    return out


PAIRS = (("M2", "M1"), ("M4", "M4nok"), ("E1", "M4"), ("E2", "M4"), ("E1'", "M4"), ("M1", "M0"), ("M4", "M1"))


@query()
def replication_gains(spark, sf_dir):
    """Gains an event of the named models over those that they extend, on the validation part, with intervals over
    blocks of several sizes."""
    specs = [s for name, s in named().items() if name != "E1+E2"]
    shared = shared_rows(spark, sf_dir, specs, STARTS)
    results = fits.fit_all(shared, specs, A_NS, CUT_NS, tolerance=1e-6)
    blocks = cut(_gains(cut(fits.block_scores(shared, list(results.values()), CUT_NS, B_NS, DAY)), PAIRS))
    by = ["model", "reference"]
    return inference.verdicts(inference.block_bootstrap(inference.coarser(blocks, by, list(BLOCK_SIZES)), [*by, "factor"]))


def _controls(shared, results):
    """Each control's gain an event: marks shuffled, against no marks; states moved, against states in the baseline only."""
    names = {f"M2 marks {seed}": "M1" for seed in SHUFFLES} | {f"M4 states {x:.3f}": f"M4nok states {x:.3f}" for x in SHIFTS}
    scores = cut(fits.block_scores(shared, [r for n, r in results.items() if n in names or n in names.values()], CUT_NS, B_NS, DAY))
    gains = _gains(scores, names.items()).groupBy("model").agg((F.sum("gain") / F.sum("events")).alias("gain"))
    return gains.select(F.when(F.col("model").startswith("M2"), "marks shuffled").otherwise("states moved").alias("control"), F.col("model").alias("fit"), "gain")


def _control_specs():
    n = named()
    return [n["M1"], *(n["M2"].of(f"marks {seed}") for seed in SHUFFLES), *(n[m].of(f"states {x:.3f}") for x in SHIFTS for m in ("M4", "M4nok"))]


@query()
def model_ladder(spark, sf_dir):
    """All named models, fitted on the first part over one excitation, scored on it and on the validation part; the KS
    distances of their residuals there, and the largest branching of a type."""
    specs = list(named().values())
    shared = shared_rows(spark, sf_dir, specs, STARTS)
    results = fits.fit_all(shared, specs, A_NS, CUT_NS, tolerance=1e-6)
    trained = shared.tape.filter((F.col("t_ns") >= A_NS) & (F.col("t_ns") < CUT_NS)).count()
    scores = fits.block_scores(shared, list(results.values()), CUT_NS, B_NS, DAY).groupBy(F.col("name").alias("model")).agg((-F.sum("loglik") / F.sum("events")).alias("val_nll"))
    rows = None
    for s in specs:
        seen, _, steps = shared.rows(s)
        own = h.rescaled_residuals(shared.excited(s, results[s.name].model), q.split_intervals(seen_with_edges(seen), steps, ["key", *SEG], B_NS), results[s.name].model, ["key", *SEG], CUT_NS, B_NS)
        own = own.select(F.lit(s.name).alias("model"), "m", "residual")
        rows = own if rows is None else union(rows, own)
    ks = a.ks_exponential(cut(rows), ["model", "m"], "residual", large=True).groupBy("model").pivot("m", list(range(K))).agg(F.first("ks"))
    facts = [(name, -r.trace[-1] / trained, float(r.model.branching().sum(axis=0).max()), len(r.trace)) for name, r in results.items()]
    told = spark.createDataFrame(facts, "model string, train_nll double, branching double, passes int")
    return told.join(scores, "model").join(ks.select("model", *(F.col(str(k)).alias(f"ks{k}") for k in range(K))), "model", "left")


@query()
def ladder_gains(spark, sf_dir):
    """What fitted marks gain in the kernel on the validation part, and what marks shuffled before a refit gain."""
    n = named()
    specs = [n["M1"], n["M2"], n["M2"].of("marks 1")]
    shared = shared_rows(spark, sf_dir, specs, STARTS, SHUFFLES[:1])
    results = fits.fit_all(shared, specs, A_NS, CUT_NS, tolerance=1e-6)
    scores = cut(fits.block_scores(shared, list(results.values()), CUT_NS, B_NS, DAY))
    return inference.verdicts(inference.block_bootstrap(cut(_gains(scores, [("M2", "M1"), ("M2 marks 1", "M1")])), ["model"]))


@query()
def refitted_controls(spark, sf_dir):
    """Three shuffles of marks and five moves of states, each refitted, in one batch of fits: gains, mean and deviation."""
    specs = _control_specs()
    shared = shared_rows(spark, sf_dir, specs, STARTS, SHUFFLES, SHIFTS)
    gains = _controls(shared, fits.fit_all(shared, specs, A_NS, CUT_NS, tolerance=1e-6))
    over = Window.partitionBy("control")
    return gains.withColumns({"mean": F.avg("gain").over(over), "sd": F.stddev_samp("gain").over(over)})


@query()
def hypotheses(spark, sf_dir):
    """The nine claims of the ladder about the fitted models, each with its statistic and verdict; see ``ladder.claims``."""
    n = named()
    specs = [*(s for name, s in n.items() if name != "E1+E2"), *_control_specs()[1:]]
    shared = shared_rows(spark, sf_dir, specs, STARTS, SHUFFLES, SHIFTS)
    results = fits.fit_all(shared, specs, A_NS, CUT_NS, tolerance=1e-6)
    scores = cut(fits.block_scores(shared, [results[name] for name in n if name in results], CUT_NS, B_NS, DAY))
    gains = inference.block_bootstrap(cut(_gains(scores, PAIRS)), ["model", "reference"]).collect()
    controls = _controls(shared, results).groupBy("control").agg(F.avg("gain").alias("mean"), F.stddev_samp("gain").alias("sd")).collect()
    means = {}
    for name in ("M4", "E1", "E1'"):
        seen, _, steps = shared.rows(n[name])
        own = h.rescaled_residuals(shared.excited(n[name], results[name].model), q.split_intervals(seen_with_edges(seen), steps, ["key", *SEG], B_NS), results[name].model, ["key", *SEG], CUT_NS, B_NS)
        rows = ladder.diagnostics(own, seen, ["key", *SEG], START_NS, 6 * HOUR, {"burst": ladder.EDGES["burst"], "opp_gap": ladder.EDGES["opp_gap"], "hour": (480.0,)}, errors=True)
        means[name] = rows.filter(F.col("measure").contains("mean by") | F.col("measure").contains("error by")).collect()
    rows = ladder.claims({(g.model, g.reference): (g.estimate, g.low) for g in gains}, {c.control: (c["mean"], c.sd) for c in controls}, {k: r.model for k, r in results.items()}, means, S, 4, HALF_LIVES[0])
    return spark.createDataFrame(rows, "claim string, statistic string, value double, confirmed boolean")


def seen_with_edges(t):
    """The tape with the edge rows that shared rows have, so that both number events alike."""
    return h.with_edges(t, ["key", *SEG], STARTS)


@query()
def extension_grid(spark, sf_dir):
    """Five grids of decay rates and blocks of one model, over one excitation: score, gain over the first, and how the
    predicted events of the validation part split into baseline and excitation, by type."""
    n = named()
    specs = [n[name] for name in ("M4", "E1", "E2", "E1+E2", "E1'")]
    shared = shared_rows(spark, sf_dir, specs, STARTS)
    results = fits.fit_all(shared, specs, A_NS, CUT_NS, tolerance=1e-6)
    scores = cut(fits.block_scores(shared, list(results.values()), CUT_NS, B_NS, DAY))
    nll = scores.groupBy(F.col("name").alias("model")).agg((-F.sum("loglik") / F.sum("events")).alias("val_nll"))
    gains = inference.block_bootstrap(cut(_gains(scores, [(s.name, "M4") for s in specs])), ["model"])
    out = None
    for s in specs:
        seen, _, steps = shared.rows(s)
        pieces_ = h.state_pieces(steps, seen, ["key", *SEG], CUT_NS, B_NS)
        rows = ladder.decomposition(seen, pieces_, results[s.name].model, ["key", *SEG], CUT_NS, B_NS)
        rows = rows.groupBy("m").agg(*(F.sum(c).alias(c) for c in ("observed", "baseline", "excited"))).withColumn("model", F.lit(s.name))
        out = rows if out is None else union(out, rows)
    return out.join(nll, "model").join(gains, "model")


@query()
def jittered_diagnostics(spark, sf_dir):
    """Diagnostics of the query model on the tape as it is and on times jittered within their tick, side by side, with the
    means' standard errors: what ties do to the distances."""
    t = tape(spark, sf_dir)
    draw = F.conv(F.substring(F.md5(F.col("seq").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    moved = q.jitter(t, SEG, HOUR, draw).withColumn("t_ns", F.col("jittered_ns")).select(*t.columns)
    out = None
    for name, own in (("raw", t), ("jittered", cut(moved))):
        kicked = h.excitation(own, SEG, BETA, J, HOUR, dots=MODEL)
        found = h.rescaled_residuals(kicked, q.split_intervals(own, v.state_steps(spark, sf_dir), SEG, END_NS), MODEL, SEG)
        rows = ladder.diagnostics(found, own, SEG, START_NS, 6 * HOUR, errors=True).withColumn("times", F.lit(name))
        out = rows if out is None else union(out, rows)
    return out.groupBy("m", "measure", "at").pivot("times", ["raw", "jittered"]).agg(F.first("value"))


#: Marks by fills in an order and by price levels that it took: a rule of merging and edges each.
MARK_RULES = {"fills": ("fills", 0, (2, 3, 4)), "fills, merged over three days": ("fills", 3 * DAY, (2, 3, 4)), "levels": ("levels", 0, (2, 3, 4)), "quantity": ("quantity", 0, (10.0, 25.0, 40.0))}


@query()
def mark_sensitivity(spark, sf_dir):
    """What marks gain in the kernel under each rule of merging fills to orders and of marking them: a tape a rule, a
    marked and a plain model each, all fitted in one batch, on blocks that all rules have in common."""
    fills = v.fills(spark, sf_dir)
    first, last = fills.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    a, c, b = first, first + int((last - first) * 0.7) // DAY * DAY, first + int((last - first) * 0.85) // DAY * DAY
    tapes, steps = {}, {}
    for name, (column, gap, edges) in MARK_RULES.items():
        orders = q.orders(fills, SYMBOL, gap)
        tapes[name] = orders.select("symbol", F.col("run").alias("seq"), F.col("timestamp_ns").alias("t_ns"), "m", v.digitize(F.col(column), edges).alias("c"), F.lit(0).alias("s"))
        steps[name] = v.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.lit(first - DAY).alias("t_ns"), F.lit(0).alias("s")).distinct()
    width = max(DAY, (b - c) // 12)
    starts = [*range(c, b, width), b]
    beta = rates((7 * 24.0, 60 * 24.0))
    shared = fits.share(tapes, steps, SYMBOL, beta, 2, 1, 4, HOUR, b, tuple(starts))
    specs = [fits.Spec(f"{kind} {name}", beta, name, False, False, kind == "marked") for name in MARK_RULES for kind in ("plain", "marked")]
    results = fits.fit_all(shared, specs, a, c, tolerance=1e-6)
    scores = cut(fits.block_scores(shared, list(results.values()), c, b, width))
    gains = inference.block_bootstrap(cut(_gains(scores, [(f"marked {name}", f"plain {name}") for name in MARK_RULES])), ["model"])
    own = lambda r: r.model.branching_by_scale()[0]
    facts = [(f"marked {name}", name, *(float(own(results[f"marked {name}"])[0, 2 * k]) for k in range(4))) for name in MARK_RULES]
    kinds = "model string, rule string, " + ", ".join(f"branching{k} double" for k in range(4))
    orders_n = shared.tape.groupBy(F.col("key").alias("rule")).agg(F.count(F.lit(1)).alias("orders"))
    return spark.createDataFrame(facts, kinds).join(orders_n, "rule").join(inference.verdicts(gains), "model").drop("model")



@query()
def free_decays(spark, sf_dir):
    """One kernel a pair of types with its own decay rate, fitted to all series: rates, half-lives and branching."""
    t = tape(spark, sf_dir).withColumns({"e": F.col("m"), "s": F.lit(0)})
    flat = h.state_pieces(v.state_steps(spark, sf_dir).withColumn("s", F.lit(0)), t, SEG, A_NS, B_NS)
    mu, alpha, beta, value = fits.fit_free(t, flat, (1, K, K), SEG, A_NS, B_NS, HOUR, rates((6.0, 72.0)), tolerance=1e-5, slack=2e-2)
    rows = [(i, j, float(mu[0, i]), float(alpha[i, j]), float(beta[i, j]), float(np.log(2) / beta[i, j]), float(alpha[i, j] / beta[i, j]), value) for i in range(K) for j in range(K)]
    return spark.createDataFrame(rows, "m int, e int, mu double, alpha double, beta double, half_life double, branching double, loglik double")


_DIAGNOSTICS_SQL = (
    _AREA_SQL
    + f""", opened AS (SELECT seg, seq, t_ns, m, residual AS x, lag(seq) OVER (PARTITION BY seg, m ORDER BY t_ns, seq) AS opener FROM residuals),
covered AS (SELECT seg, seq AS opener, c AS mark, s AS state, (SELECT count(*) FROM tape x WHERE x.seg = t.seg AND (x.t_ns < t.t_ns OR (x.t_ns = t.t_ns AND x.seq < t.seq)) AND x.t_ns >= t.t_ns - {6 * HOUR}::BIGINT) AS burst,
  coalesce((t_ns - (SELECT max(t_ns) FROM tape x WHERE x.seg = t.seg AND (x.t_ns < t.t_ns OR (x.t_ns = t.t_ns AND x.seq < t.seq)) AND x.m <> t.m)) / 1e9, 'Infinity'::DOUBLE) AS opp_gap, (t_ns - {START_NS}) / 3.6e12 AS hour FROM tape t),
x AS (SELECT * FROM opened JOIN covered USING (seg, opener) WHERE x IS NOT NULL),
ranked AS (SELECT m, x, row_number() OVER (PARTITION BY m ORDER BY x) AS k, count(*) OVER (PARTITION BY m) AS n FROM x),
centred AS (SELECT m, seg, t_ns, seq, x - avg(x) OVER (PARTITION BY m) AS x FROM x),
lagged AS (SELECT *, {", ".join(f"x * lag(x, {n}) OVER w AS l{n}" for n in a.LAGS)} FROM centred WINDOW w AS (PARTITION BY m ORDER BY seg, t_ns, seq)),
every AS (SELECT m, 'ks' AS measure, 0.0 AS pos, max(greatest(k / n - (1 - exp(-x)), 1 - exp(-x) - (k - 1) / n)) AS value FROM ranked GROUP BY m
  UNION ALL SELECT m, 'quantile', unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]), unnest(quantile_cont(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) FROM x GROUP BY m
  {" ".join(f"UNION ALL SELECT m, 'autocorrelation', {n}, sum(l{n}) / nullif(sum(x * x), 0) FROM lagged GROUP BY m" for n in a.LAGS)}
  {" ".join(f"UNION ALL SELECT m, 'mean by {name}', b.bin, avg(x) FROM (SELECT DISTINCT m FROM x) JOIN (SELECT unnest(range(0, {len(cuts) + 1})) AS bin) b ON true LEFT JOIN (SELECT m AS m2, x, {' + '.join(f'({name} >= {e})::INT' for e in cuts)} AS bin2 FROM x) y ON y.m2 = m AND y.bin2 = b.bin GROUP BY m, b.bin" for name, cuts in ladder.EDGES.items())})
SELECT m, measure, pos::DOUBLE AS at, round(value, 5) AS value FROM every"""
)


@query(_DIAGNOSTICS_SQL)
def residual_diagnostics(spark, sf_dir):
    """KS, quantiles, autocorrelation and conditional means on the openers' covariates, of the residuals in one table."""
    return ladder.diagnostics(residuals(spark, sf_dir), tape(spark, sf_dir), SEG, START_NS, 6 * HOUR).withColumn("value", F.round("value", 5))


@query(
    f"{_SCALES}, grid AS (SELECT l AS scale, beta, m, e FROM scales, (SELECT unnest(range(0, {K})) AS m), (SELECT unnest(range(0, {J})) AS e))"
    + " SELECT scale, m::INT AS m, e::INT AS e, round(ln(2) / beta, 6) AS half_life, round(0.001 / (1 + scale) * CASE WHEN e % 2 = m THEN 2 ELSE 1 END * (1 + e // 6) / beta, 9) AS branching FROM grid"
)
def branching_matrix(spark, sf_dir):
    """Branching by scale of the query model, and half-lives."""
    by_scale = MODEL.branching_by_scale()
    rows = [(n, i, j, round(float(MODEL.half_lives()[n]), 6), round(float(by_scale[n, i, j]), 9)) for n in range(len(BETA)) for i in range(K) for j in range(J)]
    return spark.createDataFrame(rows, "scale int, m int, e int, half_life double, branching double")
