"""Chunks of updates give what one fold gives; adapters and checks of books."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from propago.operators import book
from propago.operators import sequence as q
from propago.operators import summary
from propago.sources import capture as c


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunks_equal_one_fold(spark, chunk):
    r = random.Random(chunk)
    rows = [(g, u, k, r.choice(["bid", "ask"]), float(r.randint(1, 12)), r.choice([0.0, 1.0, 2.5])) for g in (0, 1, 2) for u in range(5, 40 + 7 * g) if r.random() < 0.8 for k in range(r.randint(1, 4))]
    levels = spark.createDataFrame(rows, "symbol long, update long, pos long, side string, price double, quantity double")
    first = spark.createDataFrame([(0, "bid", 3.5, 1.0), (1, "ask", 9.5, 2.0), (1, "ask", 30.0, 1.0)], "symbol long, side string, price double, quantity double")
    for snapshot in (None, first):
        whole = book.replay(levels, ["symbol"], snapshot=snapshot, top=True, chunk=None)
        parts = book.replay(levels, ["symbol"], snapshot=snapshot, top=True, chunk=chunk)
        assert rows_of(parts) == rows_of(whole) and whole.count() == levels.select("symbol", "update").distinct().count()
    assert book.replay(levels.filter("false"), ["symbol"], chunk=chunk).count() == 0


def test_tiles_equal_a_dictionary_of_levels(spark):
    """Series of many tiles and of few rows, over small Arrow batches, against one plain fold; one replay in the plan."""
    r = random.Random(7)
    rows = [(g, u, k, r.choice(["bid", "ask"]), float(r.randint(1, 400)), r.choice([0.0, 1.0, 2.5])) for g, n in ((0, 900), (1, 3), (2, 40)) for u in range(n) for k in range(r.randint(1, 3))]
    levels = spark.createDataFrame(rows, "symbol long, update long, pos long, side string, price double, quantity double")
    want, held = set(), {}
    for n, (g, u, _, side, price, quantity) in enumerate(rows):
        held.setdefault(g, {})[side, price] = quantity
        if n + 1 < len(rows) and rows[n + 1][:2] == (g, u):
            continue
        for name, sign in (("bid", -1), ("ask", 1)):
            live = sorted((sign * p, q) for (s, p), q in held[g].items() if s == name and q > 0)[: book.DEPTH]
            want |= {(g, u, name, k + 1, sign * p, q) for k, (p, q) in enumerate(live)}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        tops = book.top_levels(book.replay(levels, ["symbol"], top=True, chunk=None), ["symbol"])
        found = [tuple(x) for x in tops.collect()]
    finally:
        spark.conf.set(size, before)
    assert len(found) == len(want) and set(found) == want
    assert tops._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_updates_with_arrays(spark):
    kinds = "symbol long, update long, bids array<struct<price:decimal(38,18),quantity:decimal(38,18)>>, asks array<struct<price:decimal(38,18),quantity:decimal(38,18)>>"
    updates = spark.sql("SELECT 0L AS symbol, 1L AS update, array(named_struct('price', 10.0, 'quantity', 2.0), named_struct('price', 9.0, 'quantity', 1.0)) AS bids, array(named_struct('price', 11.0, 'quantity', 3.0)) AS asks")
    updates = updates.unionByName(spark.sql("SELECT 0L AS symbol, 2L AS update, array(named_struct('price', 10.0, 'quantity', 0.0)) AS bids, array() AS asks")).select("symbol", "update", F.col("bids").cast(kinds.split("bids ")[1].split(", asks")[0]).alias("bids"), F.col("asks").cast(kinds.split("asks ")[1]).alias("asks"))
    levels = book.from_arrays(updates, ["symbol"])
    assert sorted((r.update, r.pos, r.side, r.price, r.quantity) for r in levels.collect()) == [(1, 0, "bid", 10.0, 2.0), (1, 1, "bid", 9.0, 1.0), (1, 2, "ask", 11.0, 3.0), (2, 0, "bid", 10.0, 0.0)]
    states = book.replay(levels, ["symbol"])
    assert sorted((r.update, r.best_bid, r.best_ask) for r in book.assert_uncrossed(states).collect()) == [(1, 10.0, 11.0), (2, 9.0, 11.0)]
    with pytest.raises(Exception, match="is not true"):
        book.assert_uncrossed(states.withColumn("best_bid", F.lit(12.0))).collect()


def test_running_sums_and_lags_by_chunks(spark):
    r = random.Random(2)
    rows = [(g, t, k, r.choice([None, 1.0, 2.0])) for g in (0, 1) for k, t in enumerate(sorted(r.randint(0, 60) for _ in range(50)))]
    df = spark.createDataFrame(rows, "g long, t long, seq long, x double")
    out = q.previous(q.running_before(df, ["g"], ["t", "seq"], {"total": F.col("x"), "n": F.lit(1)}, F.floor(F.col("t") / 7)), ["g"], ["t", "seq"], {"was": "seq"}, F.floor(F.col("t") / 7))
    for g in (0, 1):
        own = sorted((x for x in out.collect() if x.g == g), key=lambda x: (x.t, x.seq))
        total = 0.0
        for n, x in enumerate(own):
            assert (x.total, x.n, x.was) == (total, n, own[n - 1].seq if n else None)
            total += x.x or 0.0


def test_failures_are_records(spark):
    kinds = "symbol long, eligible boolean, span_s double, first_ns long, last_ns long, day string, fingerprint string"
    facts = spark.createDataFrame([(1, True, 9e4, 100, 200, "d1", "f1"), (1, True, 10.0, 50, 90, "d0", "f0"), (2, False, 9e4, 0, 10, "d1", "f2")], kinds)
    registry = spark.createDataFrame([(1, "f0", 0, 60, "d0")], "symbol long, fingerprint string, first_ns long, last_ns long, day string")
    out = summary.failures(summary.admission(facts, registry, 3600.0)).collect()
    assert {r.fingerprint: r.reasons for r in out} == {"f0": ["short span", "same data", "overlaps", "date taken"], "f2": ["not eligible"]}
    assert all(r.when is not None for r in out)


def test_book_of_a_captured_day(spark, tmp_path):
    side = "array<struct<price:decimal(38,18),quantity:decimal(38,18)>>"
    folder = c.partition_path(str(tmp_path), "abc", "2024-01-01")
    os.makedirs(folder)

    def put(name, rows, kinds):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / name))
        source = next(f for f in os.listdir(tmp_path / name) if f.endswith(".parquet"))
        os.rename(tmp_path / name / source, f"{folder}/{name}.parquet")

    d = lambda *levels: [(Decimal(p), Decimal(q_)) for p, q_ in levels]
    put("snapshots-3", [(10, d((10, 1), (9, 0)), d((11, 2))), (20, d((1, 1)), d((2, 2)))], f"last_seq long, bids {side}, asks {side}")
    updates = [(1, 100, 8, 9, d((99, 5)), d()), (2, 200, 11, 12, d((10, 0), (8, 3)), d()), (3, 300, 12, 12, d((99, 5)), d()), (4, 400, 13, 15, d(), d((11, 0), (12, 4)))]
    put("book_updates-3", updates, f"capture_seq long, timestamp_ns long, first_seq long, last_seq long, bids {side}, asks {side}")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        out = c.load_book(spark, str(tmp_path), "abc", "2024-01-01", cache).orderBy("update").collect()
        assert [(r.session, r.update, r.timestamp_ns, r.best_bid, r.best_ask) for r in out] == [(3, 2, 200, 8.0, 11.0), (3, 4, 400, 8.0, 12.0)]
    assert len(os.listdir(cache)) == 1
    assert rows_of(c.load_book(spark, str(tmp_path), "ABC", "2024-01-01")) == rows_of(c.load_book(spark, str(tmp_path), "abc", "2024-01-01", cache))
