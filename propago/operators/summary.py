"""Aggregations over orders, residuals and books: summaries, dispersion, quantiles, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propago.session import written
from propago.sources.views import digitize


def inter_arrival(df: DataFrame, by: list[str], t: str = "t", order: list[str] = ["run"]) -> DataFrame:  # noqa: B006
    """For each series: events, rate, mean / median / longest gap, share of zero gaps, and CV (population)."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(*order))
    g = df.withColumn("gap", gap).groupBy(*by)
    return g.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("rate"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"),
        F.avg((F.col("gap") == 0).cast("double")).alias("zero_share"), (F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))).alias("cv"),
    )


def fano(df: DataFrame, by: list[str], t: str, width: float) -> DataFrame:
    """Population variance over mean of counts in floor(span / width) equal bins; the last is closed, empty ones count.

    Empty bins need no rows: sums of counts and of their squares with the number of bins give both moments.
    """
    span = Window.partitionBy(*by)
    low, high = F.min(t).over(span), F.max(t).over(span)
    bins = F.greatest(F.lit(1), F.floor((high - low) / width))
    at = F.least(bins - 1, F.floor((F.col(t) - low) / F.nullif((high - low) / bins, F.lit(0.0))))
    counts = df.select(*by, bins.alias("bins"), F.coalesce(at, F.lit(0)).alias("bin")).groupBy(*by, "bins", "bin").agg(F.count(F.lit(1)).alias("n"))
    mean, square = F.sum("n") / F.col("bins"), F.sum(F.col("n") * F.col("n")) / F.col("bins")
    return counts.groupBy(*by, "bins").agg(mean.alias("mean"), ((square - mean * mean) / mean).alias("fano"))


def tied_times(df: DataFrame, by: list[str], t: str) -> DataFrame:
    """For each series: times with more than one event, and the events there."""
    per = df.groupBy(*by, t).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.sum((F.col("n") > 1).cast("int")).alias("tied_times"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("tied_events"))


def class_shares(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Counts of a class and their share of the group."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def crosstab(df: DataFrame, row: str, column: str, classes: int) -> DataFrame:
    """Counts and row shares of a class by another, as columns: conditional sums, no pivot pass."""
    counts = [F.sum((F.col(column) == k).cast("int")).alias(f"n{k}") for k in range(classes)]
    return df.groupBy(row).agg(*counts, F.count(F.lit(1)).alias("n")).withColumns({f"share{k}": F.col(f"n{k}") / F.col("n") for k in range(classes)})


def tercile_cuts(df: DataFrame, by: list[str], value: str, keep: Column) -> DataFrame:
    """The exact 1/3 and 2/3 quantiles, linearly interpolated, of the rows that ``keep`` holds for (training rows)."""
    return df.filter(keep).groupBy(*by).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cuts"))


def classify(df: DataFrame, cuts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Append the class of ``value`` by each series' own cuts."""
    at = F.aggregate("cuts", F.lit(0), lambda n, cut: n + (F.col(value) >= cut).cast("int"))
    return df.join(cuts, by).withColumn(name, at).drop("cuts")


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Append ``rank`` (from 1) and ``n`` in each group, for groups too large for one task.

    Rows are dealt by ranges of (by, order); a window ranks those of a range, and the few counts by range are summed up.
    """
    dealt = written(df.repartitionByRange(*(F.col(c) for c in (*by, *order))).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__size"))
    upto = Window.partitionBy(*by).orderBy("__part")
    before = counts.select(*by, "__part", (F.sum("__size").over(upto) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy(*by)).alias("n"))
    own = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    return dealt.withColumn("__own", own).join(before, [*by, "__part"]).withColumn("rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__part")


def ks_exponential(df: DataFrame, by: list[str], x: str, large: bool = False, placed: DataFrame | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of each group's x to the unit exponential; ``large`` groups are ranked by many tasks.

    ``placed`` are the rows as ``ranked`` gave them already.
    """
    if placed is not None:
        pass
    elif large:
        placed = ranked(df.select(*by, x), by, [x])
    else:
        placed = df.withColumns({"rank": F.row_number().over(Window.partitionBy(*by).orderBy(x)), "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    rank, n, cdf = F.col("rank"), F.col("n"), 1 - F.exp(-F.col(x))
    return placed.withColumn("d", F.greatest(rank / n - cdf, cdf - (rank - 1) / n)).groupBy(*by).agg(F.max("d").alias("ks"), F.count(F.lit(1)).alias("n"))


LAGS = (1, 2, 5, 10, 50, 100)


def autocorrelation(df: DataFrame, by: list[str], x: str, order: list[str], lags=LAGS, block: int | None = None) -> DataFrame:
    """For each group the centred autocorrelation at each lag: sum of x_i x_(i+h) over the sum of squares.

    With ``block``, for large groups, rows are ranked by many tasks and dealt to blocks of so many ranks; the last rows of
    a block, as many as the longest lag, are copied to the next.
    """
    means = df.groupBy(*by).agg(F.avg(x).alias("__mean"))
    if block is None:
        rows, keys, at = df.join(means, by).withColumn("__ghost", F.lit(False)), by, order
    else:
        if block < max(lags):
            raise ValueError("a block is shorter than the longest lag")
        placed = ranked(df, by, order).join(means, by).withColumn("__block", F.floor((F.col("rank") - 1) / F.lit(block)))
        copied = F.when((F.col("rank") - 1) % block >= block - max(lags), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = placed.withColumn("__late", F.explode(copied)).withColumns({"__ghost": F.col("__late") == 1, "__block": F.col("__block") + F.col("__late")})
        keys, at = [*by, "__block"], ["rank"]
    w = Window.partitionBy(*keys).orderBy(*at)
    centred = rows.withColumn("__x", F.col(x) - F.col("__mean"))
    lagged = centred.withColumns({f"__l{h}": F.col("__x") * F.lag("__x", h).over(w) for h in lags}).filter("NOT __ghost")
    return lagged.groupBy(*by).agg(*((F.sum(f"__l{h}") / F.nullif(F.sum(F.col("__x") * F.col("__x")), F.lit(0.0))).alias(f"acf{h}") for h in lags))


def exponential_quantiles(df: DataFrame, by: list[str], x: str, probs=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), large: bool = False, placed: DataFrame | None = None) -> DataFrame:
    """Each group's quantiles, linearly interpolated, beside those of the unit exponential, one row a probability."""
    if large or placed is not None:
        each = (ranked(df.select(*by, x), by, [x]) if placed is None else placed).withColumn("p", F.explode(F.array(*map(F.lit, probs))))
        away = (F.col("n") - 1) * F.col("p") - (F.col("rank") - 1)
        weight = F.greatest(F.lit(0.0), 1 - F.abs(away))
        found = each.filter(F.abs(away) < 1).groupBy(*by, "p").agg(F.sum(F.col(x) * weight).alias("empirical"))
        return found.select(*by, "p", "empirical", (-F.log1p(-F.col("p"))).alias("exponential"))
    found = df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, probs))).alias("q"))
    each = found.select(*by, F.posexplode("q").alias("i", "empirical"))
    p = F.get(F.array(*map(F.lit, probs)), F.col("i"))
    return each.select(*by, p.alias("p"), "empirical", (-F.log1p(-p)).alias("exponential"))


def conditional_means(df: DataFrame, by: list[str], x: str, covariate: str, edges) -> DataFrame:
    """Mean, standard error (sample) and rows of x in every bin of a covariate; an empty bin has nulls and 0 rows."""
    binned = df.select(*by, F.col(x).alias("x"), digitize(F.col(covariate), edges).alias("bin"))
    found = binned.groupBy(*by, "bin").agg(F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n"))
    every = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    return every.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def two_se_agreement(real: DataFrame, null: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """Whether the bins that can be compared agree within two standard errors, and how many those are."""
    both = real.join(null.select(*by, "bin", F.col("mean").alias("null_mean")), [*by, "bin"])
    usable = (F.col("n") >= least) & F.col("se").isNotNull() & F.col("null_mean").isNotNull()
    return both.groupBy(*by).agg(
        F.coalesce(F.bool_and(F.when(usable, F.abs(F.col("mean") - F.col("null_mean")) <= 2 * F.col("se"))), F.lit(True)).alias("agrees"), F.sum(F.when(usable, 1).otherwise(0)).alias("compared")
    )


def eligibility(orders: DataFrame, continuity: DataFrame, by: list[str], min_span: float, min_orders: int, snapshots: DataFrame | None = None, book: DataFrame | None = None, fingerprints: DataFrame | None = None) -> DataFrame:
    """Facts of each series, and whether it is continuous, long and large enough to be analysed.

    Given the series' snapshots, how many there are is a fact too, and one at least is asked for; given its book updates,
    their number is; given fingerprints (by, fingerprint), so is that.
    """
    facts = orders.groupBy(*by).agg((F.max("t") - F.min("t")).alias("span_s"), F.count(F.lit(1)).alias("orders"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    both = facts.join(continuity, by, "left")
    seeded = F.lit(True)
    for rows, name in ((snapshots, "snapshots"), (book, "book_rows")):
        if rows is not None:
            both = both.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by, "left").withColumn(name, F.coalesce(name, F.lit(0)))
            seeded = F.col("snapshots") >= 1 if name == "snapshots" else seeded
    if fingerprints is not None:
        both = both.join(fingerprints.select(*by, "fingerprint"), by, "left")
    return both.withColumn("eligible", F.coalesce("continuous", F.lit(False)) & seeded & (F.col("span_s") >= min_span) & (F.col("orders") >= min_orders))


def admission(facts: DataFrame, registry: DataFrame, min_span: float, accepted: DataFrame | None = None, required: int | None = None) -> DataFrame:
    """Refusal reasons of each candidate session, all of them.

    ``facts`` has symbol, eligible, span_s, first_ns, last_ns, day, fingerprint. Rules: generally eligible, long enough,
    the batch not full, not the data of a registered session, no overlap with one, its date not taken, and captured
    after every session already in the batch. ``accepted`` has the symbol and first_ns of the batch's sessions, of which
    ``required`` make it full. Candidates meet only sessions of their own symbol, by an equi-join on it.
    """
    seen = registry.select(F.col("symbol"), F.col("fingerprint").alias("r_fp"), F.col("first_ns").alias("r_first"), F.col("last_ns").alias("r_last"), F.col("day").alias("r_day"))
    both = facts.join(seen, "symbol", "left")
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = both.groupBy(*facts.columns).agg(
        hit(F.col("fingerprint") == F.col("r_fp")).alias("same"), hit((F.col("first_ns") < F.col("r_last")) & (F.col("r_first") < F.col("last_ns"))).alias("overlap"), hit(F.col("day") == F.col("r_day")).alias("taken")
    )
    if accepted is None:
        found = found.withColumns({"__held": F.lit(0), "__latest": F.lit(None).cast("long")})
    else:
        found = found.join(accepted.groupBy("symbol").agg(F.count(F.lit(1)).alias("__held"), F.max("first_ns").alias("__latest")), "symbol", "left")
    full = F.coalesce(F.col("__held"), F.lit(0)) >= F.lit(required) if required is not None else F.lit(False)
    rules = [
        (~F.coalesce(F.col("eligible"), F.lit(False)), "not eligible"), (F.col("span_s") < min_span, "short span"), (full, "batch full"), (F.col("same"), "same data"),
        (F.col("overlap"), "overlaps"), (F.col("taken"), "date taken"), (F.coalesce(F.col("first_ns") <= F.col("__latest"), F.lit(False)), "capture order"),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, name) for c, name in rules)))
    return found.withColumn("reasons", reasons).withColumn("admitted", F.size("reasons") == 0).drop("__held", "__latest")


def failures(admission: DataFrame) -> DataFrame:
    """The records of refused sessions: facts, reasons and the date of the decision. Append them to the batch's."""
    return admission.filter("NOT admitted").select("symbol", "day", "span_s", "fingerprint", "reasons", F.current_date().alias("when"))
