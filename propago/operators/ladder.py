"""Ladders of models: configurations fitted in turn on one tape, scored on named segments, compared by blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propago.operators import hawkes as h
from propago.operators import inference as x_
from propago.operators import sequence as q
from propago.operators import summary as a_
from propago.session import cut, union, written


@dataclass(frozen=True)
class Config:
    """What a model of the ladder may see: no kernel scale is Poisson; states in the baseline, states or marks in the kernel."""

    name: str
    scales: tuple[float, ...] = ()
    baseline_state: bool = True
    kernel_state: bool = False
    kernel_mark: bool = False


def standard(scales: tuple[float, ...]) -> list[Config]:
    """Poisson with and without states, then Hawkes, with marks, with states, with both."""
    return [
        Config("poisson", baseline_state=False), Config("poisson states"), Config("hawkes", scales), Config("hawkes marks", scales, kernel_mark=True),
        Config("hawkes states", scales, kernel_state=True), Config("hawkes marks and states", scales, kernel_state=True, kernel_mark=True),
    ]


def encode(tape: DataFrame, c: Config, types: int, states: int, marks: int) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """The tape with the exciting types and states that the configuration sees, and the model's shape."""
    n_states = states if c.kernel_state else 1
    s, k = (F.col("s") if c.kernel_state else F.lit(0)), (F.col("c") if c.kernel_mark else F.lit(0))
    e = F.col("m") + types * (s + n_states * k)
    out = tape.withColumns({"e": e, "s": F.col("s") if c.baseline_state else F.lit(0)})
    return out, (states if c.baseline_state else 1, types, max(1, len(c.scales)), types * n_states * (marks if c.kernel_mark else 1))


@dataclass(frozen=True)
class Fitted:
    """A model with the tape and the state function that it sees, and that tape's excitation."""

    config: Config
    model: h.Model
    tape: DataFrame
    steps: DataFrame
    excited: DataFrame


def fit(tape: DataFrame, steps: DataFrame, c: Config, by: list[str], dims: tuple[int, int, int], a_ns: int, b_ns: int, unit_ns: int, edges: tuple = (), rounds: int = 400, tolerance: float = 1e-7, chunk_ns: int | None = None) -> Fitted:
    """The maximum-likelihood model on [a, b), its baseline continued after b by its mean over the blocks, state by state.

    Raises RuntimeError if the fit does not converge.
    """
    seen, shape = encode(tape, c, *dims)
    own = steps if c.baseline_state else steps.withColumn("s", F.lit(0))
    beta = c.scales or (1.0,)
    excited = cut(h.excitation(seen, by, beta, shape[3], unit_ns, chunk_ns))
    cells = cut(h.state_pieces(own, seen, by, a_ns, b_ns))
    if c.scales:
        m = h.fit_pooled(excited, cells, shape, beta, a_ns, b_ns, unit_ns, rounds, tolerance, edges, seen)[0]
    else:
        m = h.poisson_fit(seen, cells, shape[0], shape[1], shape[3], a_ns, b_ns, unit_ns, edges)
    return Fitted(c, h.extrapolate(m, h.block_time(cells, m), b_ns), seen, own, excited)


def evaluate(f: Fitted, by: list[str], segments: dict[str, tuple[int, int]], ks_on: str | None = None, end_ns: int | None = None) -> dict[str, float]:
    """Negative log-likelihood an event on the named segments only, and on ``ks_on`` the KS distance of each type.

    A test segment is scored only if it is named.
    """
    out = {}
    for name, (a, b) in segments.items():
        r = h.log_likelihood(f.excited, h.state_pieces(f.steps, f.tape, by, a, b), f.model, by, a, b, f.tape).agg(F.sum("loglik").alias("ll"), F.sum("events").alias("n")).first()
        out[name] = -r.ll / max(1, r.n)
    if ks_on:
        pieces = q.split_intervals(f.tape, f.steps, by, end_ns or segments[ks_on][1])
        found = a_.ks_exponential(h.rescaled_residuals(f.excited, pieces, f.model, by, *segments[ks_on]), ["m"], "residual", large=True)
        out |= {f"ks{r.m}": r.ks for r in found.collect()}
    return out


def run(tape: DataFrame, steps: DataFrame, configs: list[Config], by: list[str], dims: tuple[int, int, int], train: tuple[int, int], segments: dict[str, tuple[int, int]], unit_ns: int, edges: tuple = (), ks_on: str | None = None, tolerance: float = 1e-7) -> list[dict]:
    """Name, scores by segment and total branching of each configuration."""
    out = []
    for c in configs:
        f = fit(tape, steps, c, by, dims, *train, unit_ns, edges, tolerance=tolerance)
        out.append({"model": c.name, **evaluate(f, by, segments, ks_on), "branching": float(f.model.branching().sum(axis=0).max())})
    return out


def gain_blocks(reference: Fitted, other: Fitted, by: list[str], a_ns: int, b_ns: int, block_ns: int) -> DataFrame:
    """(block, gain, events) on [a, b): what ``other`` gains over ``reference`` in log-likelihood, block by block."""
    blocks = lambda f: h.block_log_likelihood(f.tape, f.steps, f.model, by, a_ns, b_ns, block_ns, b_ns)
    return cut(x_.paired_blocks(blocks(reference), blocks(other), ["block"]))


def gain(reference: Fitted, other: Fitted, by: list[str], a_ns: int, b_ns: int, block_ns: int, resamples: int = 2000) -> DataFrame:
    """(estimate, low, high, verdict) of the gain an event, by bootstrap over blocks."""
    blocks = gain_blocks(reference, other, by, a_ns, b_ns, block_ns).withColumn("g", F.lit(0))
    return x_.verdicts(x_.block_bootstrap(blocks, ["g"], resamples)).drop("g")


def with_shuffled_marks(tape: DataFrame, by: list[str], edges_ns: list[int], seed: int) -> DataFrame:
    """The tape with marks shuffled within each series, segment of time (from each edge) and type: a control to refit."""
    dealt = tape.withColumn("__part", q.block_of(F.col("t_ns"), [0, *edges_ns]))
    draw = F.md5(F.concat_ws(":", "seq", F.lit(str(seed))))
    out = q.grouped_shuffle(dealt, [*by, "__part", "m"], ["t_ns", "seq"], "c", draw)
    return out.withColumn("c", F.col("shuffled")).drop("shuffled", "__part")


def with_shifted_states(steps: DataFrame, by: list[str], edges_ns: list[int], share: float) -> DataFrame:
    """The state function with states moved around, by a share of the steps of each series and segment: a control to refit."""
    dealt = steps.withColumn("__part", q.block_of(F.col("t_ns"), [0, *edges_ns]))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "__part"))
    placed = dealt.withColumn("__shift", F.floor(n * share))
    out = q.circular_shift(placed, [*by, "__part"], ["t_ns"], "s", F.col("__shift"))
    return out.withColumn("s", F.col("shifted")).drop("shifted", "__part", "__shift")


def exceeds_controls(estimate: float, low: float, mean: float, sd: float, least: float, deviations: float = 3.0) -> bool:
    """Whether a gain is over ``least``, its interval above zero, and over the controls' mean by so many deviations."""
    return bool(estimate > least and low > 0 and estimate > mean + deviations * sd)


def fast_share_by_mark(m: h.Model, limit: float, states: int, marks: int) -> np.ndarray:
    """(marks, types): the share of each type's own branching at half-lives up to ``limit``, by the parent's mark."""
    by_scale, k = m.branching_by_scale(), m.shape[1]
    own = np.array([[by_scale[:, i, [i + k * (s + states * c) for s in range(states)]].sum(axis=1) for i in range(k)] for c in range(marks)])
    return own[:, :, m.half_lives() <= limit].sum(axis=2) / np.maximum(own.sum(axis=2), 1e-300)


def monotone(values, falling: bool = False) -> bool:
    """Whether numbers strictly rise (or fall)."""
    steps = np.diff(np.asarray(values, float))
    return bool((steps < 0).all() if falling else (steps > 0).all())


def agrees(rows: list, names: tuple[str, ...], deviations: float = 2.0, least: int = 30) -> bool:
    """Whether every bin's mean residual is within so many standard errors of 1, its value under the model; bins of fewer
    than ``least`` intervals do not count. ``rows`` are those of ``diagnostics`` with errors."""
    at = {(r.m, r.measure, r.at): r.value for r in rows}
    ok = True
    for (m, measure, bin_), mean in at.items():
        name = measure.removeprefix("mean by ")
        if measure.startswith("mean by ") and name in names and (at.get((m, f"count by {name}", bin_)) or 0) >= least:
            ok &= abs(mean - 1) <= deviations * at[m, f"error by {name}", bin_]
    return bool(ok)


def claims(gains: dict, controls: dict, models: dict[str, h.Model], means: dict[str, list], states: int, marks: int, fast: float) -> list[tuple[str, str, float, bool]]:
    """(claim, statistic, value, confirmed) of the nine claims about the fitted ladder.

    H1 marks in the kernel gain over 0.05 an event, and over refits on shuffled marks; H2 larger orders excite faster;
    H3 states in the kernel gain over 0.005, and over refits on moved states; H4 a state turns a type's own fast and slow
    excitation opposite ways, and the other type's the other way around; H5 the baselines rise and fall with the state;
    H6 residuals of the full model do not depend on bursts or the opposite side; H7 nor do those with slow scales on the
    hour; H8 a dense grid gains; H9 slow scales gain without blocks of the baseline, and their residuals keep to the hour.
    ``gains`` are (estimate, low) by (model, reference), ``controls`` (mean, deviation) by kind.
    """
    types, out = models["M4"].shape[1], []
    put = lambda claim, ok, **values: out.extend((claim, name, float(x), bool(ok)) for name, x in values.items())
    for claim, pair, kind, least in (("H1", ("M2", "M1"), "marks shuffled", 0.05), ("H3", ("M4", "M4nok"), "states moved", 0.005)):
        (gain_, low), (mean, sd) = gains[pair], controls[kind]
        put(claim, exceeds_controls(gain_, low, mean, sd, least), gain=gain_, low=low, control_mean=mean, control_sd=sd)
    share = fast_share_by_mark(models["M2"], fast, 1, marks)
    rises = (np.diff(share, axis=0) >= -1e-9).all()
    put("H2", rises and (share[-1] > 0.7).all() and (share[0] < 0.3).all(), **{f"mark {c} type {i}": share[c, i] for c in range(marks) for i in range(types)})
    by_scale = models["M4"].branching_by_scale()
    quick, slow = by_scale[0], by_scale[max(0, len(by_scale) - 2)]
    own = lambda table, i: [table[i, i + types * s] for s in range(states)]
    turned = monotone(own(quick, 0)) and monotone(own(slow, 0), falling=True) and monotone(own(quick, 1), falling=True) and monotone(own(slow, 1))
    put("H4", turned, **{f"{name} type {i} state {s}": x for name, table in (("fast", quick), ("slow", slow)) for i in range(types) for s, x in enumerate(own(table, i))})
    mu = np.array(models["M4"].mu)[-states:]
    put("H5", monotone(mu[:, 0]) and monotone(mu[:, 1], falling=True), **{f"baseline type {i} state {s}": mu[s, i] for i in range(types) for s in range(states)})
    first = lambda name, what: next((r.value for r in means[name] if r.measure == f"mean by {what}" and r.at == 0 and r.m == 0 and r.value is not None), float("nan"))
    put("H6", agrees(means["M4"], ("burst", "opp_gap")), burst=first("M4", "burst"), opp_gap=first("M4", "opp_gap"))
    put("H7", agrees(means["E1"], ("hour",)), M4_hour=first("M4", "hour"), E1_hour=first("E1", "hour"))
    put("H8", gains["E2", "M4"][1] > 0, gain=gains["E2", "M4"][0], low=gains["E2", "M4"][1])
    put("H9", gains["E1'", "M4"][1] > 0 and agrees(means["E1'"], ("hour",)), gain=gains["E1'", "M4"][0], low=gains["E1'", "M4"][1], hour=first("E1'", "hour"))
    return out


def decomposition(excited: DataFrame, pieces: DataFrame, m: h.Model, by: list[str], a_ns: int, b_ns: int) -> DataFrame:
    """(by, m, observed, baseline, excited): events of a type in [a, b), and how many the parts of the model predict."""
    k = m.shape[1]
    flat = h.model(m.mu, [[[0.0] * m.shape[3]] * k] * m.shape[2], m.beta, m.unit_ns, m.edges)
    total = h.compensator(excited, pieces, m, by, a_ns, b_ns)
    base = h.compensator(excited, pieces, flat, by, a_ns, b_ns).withColumnRenamed("compensator", "baseline")
    seen = excited.filter((F.col("t_ns") >= a_ns) & (F.col("t_ns") < b_ns)).groupBy(*by, "m").agg(F.count(F.lit(1)).alias("observed"))
    both = total.join(base, [*by, "m"]).join(seen, [*by, "m"], "left")
    return both.select(*by, "m", F.coalesce("observed", F.lit(0)).alias("observed"), "baseline", (F.col("compensator") - F.col("baseline")).alias("excited"))


#: Bins of the covariates of the event that opens an interval.
EDGES = {"mark": (1, 2, 3), "state": (1, 2), "burst": (1, 2, 4), "opp_gap": (3600.0, 21600.0, 86400.0), "hour": (120.0, 240.0, 360.0, 480.0)}


def diagnostics(residuals: DataFrame, tape: DataFrame, by: list[str], start_ns: int, window_ns: int, edges: dict[str, tuple] = EDGES, block: int = 100_000, errors: bool = False) -> DataFrame:
    """KS distance, quantiles, autocorrelation and conditional means by type as one long table (m, measure, at, value).

    The covariates are those of the event that opened a residual's interval: its mark and state, events in the window
    before it, seconds since the last of another type (infinite if none), hours since the start. So nothing later than
    the interval's start is looked at. With ``errors``, the standard errors and counts of the means are rows too.
    """
    known = tape.withColumns({"burst": q.burst_count(window_ns, by), "opp_gap": F.coalesce(q.opposite_gap(by), F.lit(float("inf"))), "hour": (F.col("t_ns") - start_ns) / 3.6e12})
    known = known.select(*by, F.col("seq").alias("opener"), F.col("c").alias("mark"), F.col("s").alias("state"), "burst", "opp_gap", "hour")
    x = written(residuals.join(known, [*by, "opener"], "left"))
    placed = a_.ranked(x.select("m", "residual"), ["m"], ["residual"])
    long = lambda df, measure, at, value: df.select("m", F.lit(measure).alias("measure"), at.cast("double").alias("at"), value.cast("double").alias("value"))
    parts = [long(a_.ks_exponential(x, ["m"], "residual", placed=placed), "ks", F.lit(0), F.col("ks"))]
    parts.append(long(a_.exponential_quantiles(x, ["m"], "residual", placed=placed), "quantile", F.col("p"), F.col("empirical")))
    lags = cut(a_.autocorrelation(x, ["m"], "residual", [*by, "t_ns", "seq"], block=block))
    parts += [long(lags, "autocorrelation", F.lit(n), F.col(f"acf{n}")) for n in a_.LAGS]
    parts += [long(a_.conditional_means(x, ["m"], "residual", name, cuts), f"mean by {name}", F.col("bin"), F.col("mean")) for name, cuts in edges.items()]
    if errors:
        for name, cuts in edges.items():
            found = a_.conditional_means(x, ["m"], "residual", name, cuts)
            parts += [long(found, f"error by {name}", F.col("bin"), F.col("se")), long(found, f"count by {name}", F.col("bin"), F.col("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = union(out, p)
    return out
