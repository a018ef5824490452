"""Ordered-sequence operators. Every window is partitioned by the series' key ``by`` and has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propago.session import union

NS = 1_000_000_000


def collapse(fills: DataFrame, by: list[str], order: list[str] = ["capture_seq"], merge_gap_ns: int = 0) -> DataFrame:  # noqa: B006
    """Collapse runs of fills to orders.

    A run ends where the side changes or time moves on by more than ``merge_gap_ns``; a step back in time does not end
    it. The first fill starts run 1 and may be joined. Gives first and last price, total quantity, fills and levels.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    new = (F.col("timestamp_ns") - F.lag("timestamp_ns").over(w) > merge_gap_ns) | (F.col("aggressor") != F.lag("aggressor").over(w))
    runs = fills.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seq = F.struct(*order)
    first = lambda c: F.min_by(c, seq).alias(c)
    return runs.groupBy(*by, "run").agg(
        first("capture_seq"), first("timestamp_ns"), first("aggressor"), first("trade_id"),
        F.min_by("price", seq).alias("price_first"), F.max_by("price", seq).alias("price_last"),
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("fills"), F.count_distinct("price").alias("levels"),
    )


def orders(fills: DataFrame, by: list[str], merge_gap_ns: int = 0, minutes: float | None = None) -> DataFrame:
    """Collapsed fills with ``t`` (seconds from the series' first order) and ``m`` (0 buy, 1 sell); the first minutes."""
    out = collapse(fills, by, merge_gap_ns=merge_gap_ns)
    start = F.first("timestamp_ns").over(Window.partitionBy(*by).orderBy("run"))
    out = out.withColumns({"t": (F.col("timestamp_ns") - start) / NS, "m": (F.col("aggressor") == "sell").cast("int")})
    return out if minutes is None else out.filter(F.col("t") < minutes * 60)


def continuity(updates: DataFrame, by: list[str]) -> DataFrame:
    """For each series: whether each first_seq follows the previous last_seq, how often it does not, and updates."""
    w = Window.partitionBy(*by).orderBy("capture_seq")
    gap = F.col("first_seq") - F.lag("last_seq").over(w)
    return updates.withColumn("gap", gap).groupBy(*by).agg(
        F.coalesce(F.bool_and(F.col("gap") == 1), F.lit(True)).alias("continuous"), F.sum(F.coalesce((F.col("gap") != 1).cast("int"), F.lit(0))).alias("breaks"), F.count(F.lit(1)).alias("updates")
    )


def segments(updates: DataFrame, by: list[str]) -> DataFrame:
    """Append ``segment``: continuous runs of updates, numbered from 0 in each series."""
    w = Window.partitionBy(*by).orderBy("capture_seq")
    broken = F.coalesce(F.col("first_seq") - F.lag("last_seq").over(w) != 1, F.lit(False)).cast("int")
    return updates.withColumn("segment", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fresh_updates(updates: DataFrame, by: list[str], snapshot_seq: Column | int) -> DataFrame:
    """Updates past the snapshot and past every earlier update; stale ones go."""
    w = Window.partitionBy(*by).orderBy("capture_seq").rowsBetween(Window.unboundedPreceding, -1)
    floor = snapshot_seq if isinstance(snapshot_seq, Column) else F.lit(snapshot_seq)
    seen = F.greatest(F.coalesce(F.max("last_seq").over(w), floor), floor)
    return updates.withColumn("__seen", seen).filter(F.col("last_seq") > F.col("__seen")).drop("__seen")


def asof_backward(events: DataFrame, steps: DataFrame, by: list[str], value: str, default=None, seq: str = "seq") -> DataFrame:
    """Append to each event the ``value`` of the last step at or before its time, a step at the same time included.

    A union and one running ``last`` instead of an inequality join: one shuffle by the series, linear in its rows.
    """
    e = events.select("*", F.lit(1).alias("__kind"), F.lit(None).cast(steps.schema[value].dataType).alias("__value"))
    s = steps.select(*by, "t_ns", F.lit(0).alias("__kind"), F.col(value).alias("__value"))
    w = Window.partitionBy(*by).orderBy("t_ns", "__kind", seq).rowsBetween(Window.unboundedPreceding, 0)
    both = union(e, s, missing=True).withColumn(value, F.last("__value", ignorenulls=True).over(w))
    if default is not None:
        both = both.withColumn(value, F.coalesce(value, F.lit(default)))
    return both.filter("__kind = 1").drop("__kind", "__value")


def running_before(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], chunk: Column) -> DataFrame:
    """Append the sums of ``values`` over a series' earlier rows: within the row's chunk, plus those of earlier chunks.

    ``chunk`` rises with the order. A window runs over the rows of a chunk, so that a series is shared by many tasks;
    only one row a chunk goes through the series' own window. Null values count as zero.
    """
    held = {f"__v_{name}": F.coalesce(x, F.lit(0)) for name, x in values.items()}
    placed = df.withColumn("__chunk", chunk).withColumns(held)
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    carried = placed.groupBy(*by, "__chunk").agg(*(F.sum(c).alias(c) for c in held)).select(*by, "__chunk", *(zero(F.sum(c).over(ahead)).alias(f"__c{c}") for c in held))
    own = placed.withColumns({f"__w{c}": zero(F.sum(c).over(inside)) for c in held}).join(carried, [*by, "__chunk"])
    return own.select(*df.columns, *((F.col(f"__w__v_{name}") + F.col(f"__c__v_{name}")).alias(name) for name in values))


def previous(df: DataFrame, by: list[str], order: list[str], values: dict[str, str], chunk: Column) -> DataFrame:
    """Append under new names what columns held in the row before, null for a series' first: by chunks, as ``running_before``."""
    placed = df.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order)
    kept = F.struct(*(F.col(c).alias(name) for name, c in values.items()))
    last = placed.groupBy(*by, "__chunk").agg(F.max_by(kept, F.struct(*order)).alias("__last"))
    carried = last.select(*by, "__chunk", F.lag("__last").over(Window.partitionBy(*by).orderBy("__chunk")).alias("__last"))
    own = placed.withColumn("__lag", F.lag(kept).over(inside)).join(carried, [*by, "__chunk"])
    found = F.coalesce("__lag", "__last")
    return own.select(*df.columns, *(found[name].alias(name) for name in values))


def backfilled(steps: DataFrame, by: list[str], start_ns: Column | int) -> DataFrame:
    """A state function (by, t_ns, s) that holds from ``start_ns`` on: where a series' first step is later, its state holds
    before it too. Series without steps stay without."""
    start = start_ns if isinstance(start_ns, Column) else F.lit(start_ns)
    first = steps.groupBy(*by).agg(F.min("t_ns").alias("__first"), F.min_by("s", F.struct("t_ns", "s")).alias("s")).filter(F.col("__first") > start)
    return union(steps.select(*by, "t_ns", "s"), first.select(*by, start.cast("long").alias("t_ns"), "s"))


def tape(raw: DataFrame, steps: DataFrame, n_types: int = 2, n_states: int = 3, kernel_state: bool = True) -> DataFrame:
    """A tape with states and exciting types e = m + K (s + S c); without state in the kernel S counts as 1."""
    with_state = asof_backward(raw, steps, ["seg"], "s", default=0)
    state, count = (F.col("s"), n_states) if kernel_state else (F.lit(0), 1)
    return with_state.withColumn("e", F.col("m") + n_types * (state + count * F.col("c")))


def trailing_count(mask: Column, window_ns: int, by: list[str], seq: str = "seq") -> Column:
    """Masked events up to this one in capture order with time over t - window: causal even where times tie.

    Rows up to the current one, less those at or before t - window; a single range frame would see later ties.
    """
    flag = F.coalesce(mask.cast("int"), F.lit(0))
    upto = Window.partitionBy(*by).orderBy("t_ns", seq).rowsBetween(Window.unboundedPreceding, 0)
    old = Window.partitionBy(*by).orderBy("t_ns").rangeBetween(Window.unboundedPreceding, -window_ns)
    return F.sum(flag).over(upto) - F.coalesce(F.sum(flag).over(old), F.lit(0))


def burst_count(window_ns: int, by: list[str], seq: str = "seq") -> Column:
    """Events before this one in capture order with time at or after t - window."""
    before = Window.partitionBy(*by).orderBy("t_ns", seq).rowsBetween(Window.unboundedPreceding, -1)
    old = Window.partitionBy(*by).orderBy("t_ns").rangeBetween(Window.unboundedPreceding, -window_ns - 1)
    return F.count(F.lit(1)).over(before) - F.count(F.lit(1)).over(old)


def opposite_gap(by: list[str], n_types: int = 2, seq: str = "seq") -> Column:
    """Seconds since the last earlier event of any other type; null if there is none."""
    before = Window.partitionBy(*by).orderBy("t_ns", seq).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("m") != k, F.max(F.when(F.col("m") == k, F.col("t_ns"))).over(before)) for k in range(n_types)]
    return (F.col("t_ns") - F.greatest(*last)) / NS if n_types > 2 else (F.col("t_ns") - F.coalesce(*last)) / NS


def log_gap(by: list[str], eps: float = 5e-4, seq: str = "seq") -> Column:
    """log of the seconds since the previous event plus eps; 0 for the first."""
    w = Window.partitionBy(*by).orderBy("t_ns", seq)
    return F.coalesce(F.log((F.col("t_ns") - F.lag("t_ns").over(w)) / NS + eps), F.lit(0.0))


def summaries(tape: DataFrame, by: list[str], windows_ns: list[int], top_windows_ns: list[int], n_types: int = 2, top: int = 3) -> DataFrame:
    """Append log1p trailing counts by type and window, those of the top mark class, and the log gap."""
    add = {f"n_m{k}_w{i}": F.log1p(trailing_count(F.col("m") == k, w, by)) for i, w in enumerate(windows_ns) for k in range(n_types)}
    add |= {f"top_m{k}_w{i}": F.log1p(trailing_count((F.col("m") == k) & (F.col("c") == top), w, by)) for i, w in enumerate(top_windows_ns) for k in range(n_types)}
    return tape.withColumns(add | {"log_gap": log_gap(by)})


def openers(tape: DataFrame, by: list[str], window_ns: int) -> DataFrame:
    """For each event but the last of its type: its covariates as the opener of the interval to the next of that type."""
    w = Window.partitionBy(*by, "m").orderBy("t_ns", "seq")
    out = tape.withColumns({"burst": burst_count(window_ns, by), "opp_gap": opposite_gap(by), "next_t_ns": F.lead("t_ns").over(w)})
    return out.filter("next_t_ns IS NOT NULL")


def split_intervals(tape: DataFrame, steps: DataFrame, by: list[str], end_ns: Column | int) -> DataFrame:
    """Cut the time from each event to the next (the last: to ``end_ns``) at the steps strictly inside.

    Rows (by, k, u0_ns, u1_ns, s): k is the owning event's position. Empty intervals give no piece. Breakpoints of both
    kinds are united and ordered; no inequality join.
    """
    w = Window.partitionBy(*by).orderBy("t_ns", "seq")
    own = tape.select(*by, F.col("t_ns"), (F.row_number().over(w) - 1).cast("long").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("s"), F.col("seq"))
    cuts = steps.select(*by, "t_ns", F.lit(None).cast("long").alias("k"), F.lit(0).alias("kind"), F.col("s").cast("int"), F.lit(None).cast("long").alias("seq"))
    both = union(own, cuts)
    order = Window.partitionBy(*by).orderBy("t_ns", "kind", "seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    end = end_ns if isinstance(end_ns, Column) else F.lit(end_ns)
    out = both.select(*by, F.last("k", ignorenulls=True).over(running).alias("k"), F.col("t_ns").alias("u0_ns"), F.coalesce(F.lead("t_ns").over(order), end).alias("u1_ns"), F.coalesce(F.last("s", ignorenulls=True).over(running), F.lit(0)).alias("s"))
    return out.filter("k IS NOT NULL AND u1_ns > u0_ns")


def clip_pieces(pieces: DataFrame, a_ns: int, b_ns: int, block_ns: int | None = None) -> DataFrame:
    """The parts of pieces inside [a, b), cut at multiples of ``block_ns`` from a; ``block`` numbers them."""
    inside = pieces.withColumns({"u0_ns": F.greatest("u0_ns", F.lit(a_ns)), "u1_ns": F.least("u1_ns", F.lit(b_ns))}).filter("u1_ns > u0_ns")
    if block_ns is None:
        return inside.withColumn("block", F.lit(0).cast("long"))
    at = lambda x: F.floor((x - a_ns) / F.lit(block_ns))
    dealt = inside.withColumn("block", F.explode(F.sequence(at(F.col("u0_ns")), at(F.col("u1_ns") - 1))))
    start = F.lit(a_ns) + F.col("block") * block_ns
    return dealt.withColumns({"u0_ns": F.greatest("u0_ns", start), "u1_ns": F.least("u1_ns", start + block_ns)})


def circular_shift(df: DataFrame, by: list[str], order: list[str], value: str, shift: Column | int) -> DataFrame:
    """Append ``shifted``: the value of the row ``shift`` places earlier in its group, around the end."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = df.withColumns({"__rn": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    k = shift if isinstance(shift, Column) else F.lit(shift)
    given = placed.select(*by, F.pmod(F.col("__rn") + k, F.col("__n")).alias("__rn"), F.col(value).alias("shifted"))
    return placed.join(given, [*by, "__rn"]).drop("__rn", "__n")


def grouped_shuffle(df: DataFrame, groups: list[str], order: list[str], value: str, draw: Column) -> DataFrame:
    """Append ``shuffled``: the group's values in the order of ``draw``, a hash or random column, ties by ``order``."""
    natural = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    drawn = F.row_number().over(Window.partitionBy(*groups).orderBy(draw, *order))
    placed = df.withColumns({"__at": natural, "__from": drawn})
    given = placed.select(*groups, F.col("__from").alias("__at"), F.col(value).alias("shuffled"))
    return placed.join(given, [*groups, "__at"]).drop("__at", "__from")


def jitter(tape: DataFrame, by: list[str], tick_ns: int, draw: Column) -> DataFrame:
    """Append ``jittered_ns``: t plus an offset in [0, tick); ties get their offsets in ascending capture order."""
    tied = Window.partitionBy(*by, "t_ns")
    placed = tape.withColumn("__u", (draw * tick_ns).cast("long"))
    placed = placed.withColumns({"__at": F.row_number().over(tied.orderBy("seq")), "__rank": F.row_number().over(tied.orderBy("__u", "seq"))})
    given = placed.select(*by, "t_ns", F.col("__rank").alias("__at"), F.col("__u").alias("__offset"))
    return placed.join(given, [*by, "t_ns", "__at"]).withColumn("jittered_ns", F.col("t_ns") + F.col("__offset")).drop("__u", "__at", "__rank", "__offset")


def token_window(tape: DataFrame, by: list[str], size: int, eps: float = 5e-4) -> DataFrame:
    """Append ``tokens``: the last ``size`` events up to this one, with their log age and gap, and ``pad``: how many are missing."""
    w = Window.partitionBy(*by).orderBy("t_ns", "seq").rowsBetween(-(size - 1), 0)
    held = F.collect_list(F.struct("t_ns", "m", "s", "c", F.col("__gap").alias("gap"))).over(w)
    aged = F.transform("__held", lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), x["c"].alias("c"), F.log((F.col("t_ns") - x["t_ns"]) / NS + eps).alias("log_age"), x["gap"].alias("log_gap")))
    return tape.withColumn("__gap", log_gap(by, eps)).withColumn("__held", held).withColumns({"tokens": aged, "pad": F.lit(size) - F.size("__held")}).drop("__held", "__gap")


def observe(tape: DataFrame, by: list[str], tick_ns: int) -> DataFrame:
    """What a feed with a coarse clock shows: times floored to the tick, runs of a side within one merged, largest mark."""
    w = Window.partitionBy(*by).orderBy("t_ns", "seq")
    floored = tape.withColumn("o_ns", F.floor(F.col("t_ns") / tick_ns) * tick_ns)
    new = (F.col("o_ns") != F.lag("o_ns").over(w)) | (F.col("m") != F.lag("m").over(w))
    runs = floored.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("o_ns").alias("t_ns"), F.min("m").alias("m"), F.max("c").alias("c"), F.count(F.lit(1)).alias("merged"))


def before(tape: DataFrame, end_ns: int) -> DataFrame:
    """Events before a time. The state function is not cut: it is known at every time."""
    return tape.filter(F.col("t_ns") < end_ns)


def block_edges(start_ns: int, end_ns: int, width_ns: int | None) -> list[int]:
    """Starts of baseline blocks; the last block is open."""
    return [start_ns] if width_ns is None else list(range(start_ns, end_ns, width_ns))


def block_of(t: Column, edges: list[int]) -> Column:
    """The block that holds a time: the number of later edges at or before it. Times before the first edge are in block 0."""
    total = F.lit(0)
    for x in edges[1:]:
        total = total + (t >= x).cast("int")
    return total


def chronological_split(t: Column, end: Column, shares: tuple[float, float] = (0.70, 0.85)) -> Column:
    """0 train, 1 validation, 2 test by half-open parts of [0, end); a time outside all, so the end itself, is 0."""
    return F.when((t >= end * shares[0]) & (t < end * shares[1]), 1).when((t >= end * shares[1]) & (t < end), 2).otherwise(0)
