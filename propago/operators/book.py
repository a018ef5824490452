"""Order-book replay, as folds of chunks of updates and as joins of validity intervals, and the features of each state."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propago.operators.hawkes import begins
from propago.session import union

#: Levels a side that features look at.
DEPTH = 10

FEATURES = "best_bid double, best_ask double, mid double, spread double, imb1 double, imb5 double, bid_depth double, ask_depth double, bid_levels long, ask_levels long, crossed boolean"
FEATURE_NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def from_arrays(updates: DataFrame, by: list[str], bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Updates with arrays of (price, quantity), decimals or not, as level rows in the order they apply: bids, then asks."""
    level = lambda side: lambda x: F.struct(F.lit(side).alias("side"), x["price"].cast("double").alias("price"), x["quantity"].cast("double").alias("quantity"))
    every = F.concat(F.transform(bids, level("bid")), F.transform(asks, level("ask")))
    return updates.select("*", F.posexplode(every).alias("pos", "l")).select(*(c for c in updates.columns if c not in (bids, asks)), F.col("pos").cast("long").alias("pos"), "l.*")


def level_counts(updates: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """Append ``levels``: how many levels an update changes."""
    return updates.withColumn("levels", F.size(bids) + F.size(asks))


class Side:
    """One side's live levels: prices times its sign in order of quality, and their quantities."""

    def __init__(self, sign: int, prices=(), quantities=()) -> None:
        self.sign = sign
        held = sign * np.asarray(prices, float)
        order = np.argsort(held, kind="stable")
        self.price, self.quantity = held[order], np.asarray(quantities, float)[order]

    def fold(self, n: int, at: np.ndarray, prices: np.ndarray, quantities: np.ndarray) -> tuple[np.ndarray, ...]:
        """Apply rows (their update among ``n``, in order, price, quantity), and give after every update the number of live
        levels, and the prices and quantities (n, DEPTH) of the best, 0 where there are fewer.

        Updates side by side as a matrix of the levels that they touch. Of the others, which do not change, only the best
        DEPTH can be among the best.
        """
        touched, code = np.unique(self.sign * prices, return_inverse=True)
        place = np.minimum(np.searchsorted(self.price, touched), max(len(self.price) - 1, 0))
        there = self.price[place] == touched if len(self.price) else np.zeros(len(touched), bool)
        still = np.ones(len(self.price), bool)
        still[place[there]] = False
        rest, held = self.price[still], self.quantity[still]
        columns = np.concatenate((touched, rest[:DEPTH]))
        order = np.argsort(columns, kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        values, since = np.zeros((n + 1, len(columns))), np.zeros((n + 1, len(columns)), np.int32)
        values[0, rank[: len(touched)][there]] = self.quantity[place[there]]
        values[0, rank[len(touched) :]] = held[:DEPTH]
        where = at + 1, rank[code]
        values[where], since[where] = quantities, where[0]
        filled = np.take_along_axis(values, np.maximum.accumulate(since, axis=0), axis=0)
        ended = filled[-1, rank[: len(touched)]]
        price, quantity = np.concatenate((rest, touched[ended > 0])), np.concatenate((held, ended[ended > 0]))
        again = np.argsort(price, kind="stable")
        self.price, self.quantity = price[again], quantity[again]
        live = filled[1:] > 0
        count = np.cumsum(live, axis=1)
        row, column = np.nonzero(live & (count <= DEPTH))
        best, depth = np.zeros((n, DEPTH)), np.zeros((n, DEPTH))
        to = row, count[row, column] - 1
        best[to], depth[to] = self.sign * columns[order][column], filled[1:][row, column]
        return (count[:, -1] if len(columns) else np.zeros(n, int)) + len(rest[DEPTH:]), best, depth


class Book:
    """Both sides of one series' book."""

    def __init__(self, bid: Side | None = None, ask: Side | None = None) -> None:
        self.bid, self.ask = bid or Side(-1), ask or Side(1)

    def fold(self, at: np.ndarray, bid: np.ndarray, prices: np.ndarray, quantities: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Apply rows in order, ``at`` being their updates from 0 on; for each side what ``Side.fold`` gives."""
        first = np.flatnonzero(np.diff(at, prepend=-1))
        parts, begin = [], 0
        while begin < len(at):  # whole updates of about TILE rows
            end = int(first[min(np.searchsorted(first, begin + TILE, "left"), len(first) - 1)]) if begin + TILE < len(at) else len(at)
            end = end if end > begin else len(at)
            own, low = slice(begin, end), at[begin]
            n, mine = int(at[end - 1] - low) + 1, bid[own]
            parts.append([side.fold(n, at[own][which] - low, prices[own][which], quantities[own][which]) for side, which in ((self.bid, mine), (self.ask, ~mine))])
            begin = end
        return [tuple(np.concatenate([x[k][i] for x in parts]) for i in range(3)) for k in (0, 1)]


def features(bid: tuple[np.ndarray, ...], ask: tuple[np.ndarray, ...]) -> list[pa.Array]:
    """The columns of FEATURES from both sides' ``Side.fold``."""
    (n, price, b), (m, other, a) = bid, ask
    none, both = (n == 0, m == 0), (n > 0) & (m > 0)
    of = lambda x, known: pa.array(x, mask=~known)
    b, a = np.cumsum(b, axis=1), np.cumsum(a, axis=1)
    gap = lambda k: of((b[:, k] - a[:, k]) / np.where(b[:, k] + a[:, k] == 0, 1, b[:, k] + a[:, k]), b[:, k] + a[:, k] != 0)
    first, least = price[:, 0], other[:, 0]
    return [
        of(first, ~none[0]), of(least, ~none[1]), of((least + first) / 2, both), of(least - first, both), gap(0), gap(4),
        pa.array(b[:, -1]), pa.array(a[:, -1]), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64)), pa.array(both & (first >= least)),
    ]


def _lists(side: tuple[np.ndarray, ...]) -> pa.Array:
    """The best levels after every update, as lists of (price, quantity)."""
    n, price, quantity = side
    sizes = np.minimum(n, DEPTH)
    kept = np.arange(DEPTH) < sizes[:, None]
    level = pa.StructArray.from_arrays([pa.array(price[kept]), pa.array(quantity[kept])], names=["price", "quantity"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), level)


_LEVELS = "array<struct<price:double,quantity:double>>"
#: Rows of a series that are applied side by side.
TILE = 512
#: Updates of a series that one task replays, from the levels that are live at the first of them.
CHUNK = 4096


def _seeds(rows: DataFrame, by: list[str], update: str) -> DataFrame:
    """(by, __chunk, side, price, quantity): the levels that are live where a chunk begins.

    A level's last quantity in each chunk that touches it holds at the start of all later chunks, up to the next one that
    touches it: aggregates and a window over chunks, no row of which is an update.
    """
    last = rows.groupBy(*by, "side", "price", "__chunk").agg(F.max_by("quantity", F.struct(F.coalesce(update, F.lit(-(1 << 62))), "pos")).alias("quantity"))
    ends = rows.groupBy(*by).agg(F.max("__chunk").alias("__most"))
    after = F.lead("__chunk").over(Window.partitionBy(*by, "side", "price").orderBy("__chunk"))
    live = last.withColumn("__next", after).filter("quantity > 0").join(ends, by)
    upto = F.coalesce("__next", F.col("__most"))
    return live.filter(upto > F.col("__chunk")).select(*by, "side", "price", "quantity", F.explode(F.sequence(F.col("__chunk") + 1, upto)).alias("__chunk"))


def replay(levels: DataFrame, by: list[str], update: str = "update", snapshot: DataFrame | None = None, top: bool = False, chunk: int | None = CHUNK) -> DataFrame:
    """Fold each series' level rows into a book and give its features after every update (by, update, features).

    A positive quantity sets a level, zero deletes it; the last row of an update wins. ``snapshot`` rows (by, side,
    price, quantity) are the state before the first update. A series is cut into chunks of ``chunk`` update numbers,
    which tasks replay in parallel, each from the levels that are live where it begins (see ``_seeds``); None: a series
    is one chunk. Sorted series pass through tasks as a stream; a task holds live levels and a batch. An empty side gives null prices; ``crossed`` marks states whose best bid is not below the ask. With
    ``top``, ``bids`` and ``asks`` hold the best DEPTH levels after every update.
    """
    zero = levels.select(*by, update, "pos", "side", "price", "quantity")
    if snapshot is not None:
        first = snapshot.select(*by, F.lit(None).cast("long").alias(update), F.lit(-1).cast("long").alias("pos"), "side", "price", "quantity")
        zero = union(zero, first)
    keys = by
    if chunk:
        keys = [*by, "__chunk"]
        # Rows of the snapshot are of a chunk before all others.
        rows = zero.withColumn("__chunk", F.coalesce(F.floor(F.col(update) / F.lit(chunk)), F.lit(-(1 << 40)).cast("long")))
        firsts = rows.filter(F.col(update).isNotNull()).groupBy(*by).agg((F.min("__chunk") - 1).alias("__before"))
        rows = rows.join(firsts, by).withColumn("__chunk", F.greatest("__chunk", "__before")).drop("__before")
        seeds = _seeds(rows, by, update).withColumns({update: F.lit(None).cast("long"), "pos": F.lit(-1).cast("long")})
        zero = union(rows.filter(F.col(update).isNotNull()), seeds)
    names = [*keys, update, "side", "price", "quantity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, book, kept = None, Book(), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                if kept is None:
                    return
                rows, kept = kept, None
            else:
                rows = pa.concat_batches([kept, batch]) if kept is not None else batch
                kept = None
            if rows.column("price").null_count or rows.column("quantity").null_count:
                raise ValueError("a level without price or quantity")
            own = [rows.column(c) for c in keys]
            new = begins(own, last)
            known = rows.column(update).is_valid().to_numpy(zero_copy_only=False)
            number = rows.column(update).fill_null(0).to_numpy()
            differ = np.diff(number, prepend=0) != 0
            differ[0] = True
            differ |= new | np.diff(known, prepend=True)
            if batch is not None:  # the last update may go on in the next batch
                end = int(np.flatnonzero(differ)[-1])
                kept = rows.slice(end)
                if not end:
                    continue
                rows, new, known, differ = rows.slice(0, end), new[:end], known[:end], differ[:end]
            at, bid = np.cumsum(differ) - 1, pc.equal(rows.column("side"), "bid").fill_null(False).to_numpy(zero_copy_only=False)
            prices, quantities = rows.column("price").to_numpy(), rows.column("quantity").to_numpy()
            found = []
            for a, b in itertools.pairwise(np.unique([0, *np.flatnonzero(new), len(at)]).tolist()):
                if new[a]:
                    book = Book()
                found.append(book.fold(at[a:b] - at[a], bid[a:b], prices[a:b], quantities[a:b]))
            last = tuple(rows.column(c)[-1].as_py() for c in keys)
            sides = [tuple(np.concatenate([x[k][i] for x in found]) for i in range(3)) for k in (0, 1)]
            told = np.flatnonzero(differ)
            real = known[told]
            sides = [tuple(x[real] for x in side) for side in sides]
            first = pa.array(told[real])
            arrays = [*(rows.column(c).take(first) for c in (*by, update)), *features(*sides), *(map(_lists, sides) if top else ())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*by, update, *FEATURE_NAMES, *(("bids", "asks") if top else ())])

    schema = ", ".join([*(f"{c} {levels.schema[c].dataType.simpleString()}" for c in by), f"{update} long", FEATURES, *((f"bids {_LEVELS}", f"asks {_LEVELS}") if top else ())])
    return zero.repartition(*keys).sortWithinPartitions(*keys, update, "pos").select(*names).mapInArrow(run, schema)


def top_levels(states: DataFrame, by: list[str], update: str = "update") -> DataFrame:
    """(by, update, side, rank, price, quantity) of the best DEPTH levels after every update, from ``replay(top=True)``."""
    side = lambda name, c: F.transform(c, lambda x, k: F.struct(F.lit(name).alias("side"), (k + 1).alias("rank"), x["price"].alias("price"), x["quantity"].alias("quantity")))
    return states.select(*by, update, F.inline(F.concat(side("bid", "bids"), side("ask", "asks"))))


def live_levels(levels: DataFrame, by: list[str], update: str = "update") -> DataFrame:
    """Validity intervals (by, side, price, quantity, from_update, to_update) of levels, half-open; null end: still live."""
    last = Window.partitionBy(*by, "side", "price", update).orderBy(F.col("pos").desc())
    kept = levels.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn")
    after = F.lead(update).over(Window.partitionBy(*by, "side", "price").orderBy(update))
    return kept.select(*by, "side", "price", "quantity", F.col(update).alias("from_update"), after.alias("to_update")).filter("quantity > 0")


def snapshot_at(levels: DataFrame, by: list[str], updates: DataFrame, update: str = "update") -> DataFrame:
    """The top DEPTH levels a side at each of ``updates`` (by, update), by joining validity intervals: exact, and meant
    for a stated set of updates. For every update of long series use ``replay``, which is linear."""
    live = live_levels(levels, by, update)
    hit = updates.select(*by, update).join(live, by).filter((F.col("from_update") <= F.col(update)) & (F.col("to_update").isNull() | (F.col("to_update") > F.col(update))))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy(*by, update, "side").orderBy(best))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= DEPTH).select(*by, update, "side", "rank", "price", "quantity")


def features_of(top: DataFrame, by: list[str], update: str = "update") -> DataFrame:
    """Best prices, mid, spread, imbalance of the first 1 and 5 levels and depth, from ranked levels."""
    pick = lambda side, depth: F.sum(F.when((F.col("side") == side) & (F.col("rank") <= depth), F.col("quantity")))
    best = lambda side: F.max(F.when((F.col("side") == side) & (F.col("rank") == 1), F.col("price")))
    sums = top.groupBy(*by, update).agg(best("bid").alias("best_bid"), best("ask").alias("best_ask"), *(F.coalesce(pick(s, d), F.lit(0.0)).alias(f"{s}{d}") for s in ("bid", "ask") for d in (1, 5, DEPTH)))
    imb = lambda d: (F.col(f"bid{d}") - F.col(f"ask{d}")) / F.nullif(F.col(f"bid{d}") + F.col(f"ask{d}"), F.lit(0.0))
    return sums.select(
        *by, update, "best_bid", "best_ask", ((F.col("best_bid") + F.col("best_ask")) / 2).alias("mid"), (F.col("best_ask") - F.col("best_bid")).alias("spread"),
        imb(1).alias("imb1"), imb(5).alias("imb5"), F.col(f"bid{DEPTH}").alias("bid_depth"), F.col(f"ask{DEPTH}").alias("ask_depth"),
    )


def assert_uncrossed(states: DataFrame) -> DataFrame:
    """The states, failing the job at the first crossed one."""
    return states.withColumn("__ok", F.assert_true(~F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False)))).filter("__ok IS NULL").drop("__ok")
