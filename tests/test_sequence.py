"""Tie semantics and boundaries on hand-written tapes."""

import hashlib
import os

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from propago.operators import book, hawkes, inference
from propago.operators import neural as n
from propago.operators import sequence as q
from propago.operators import summary as a
from propago.sources import capture as c
from propago.sources import views as v

S = 1_000_000_000
T = [0, 2, 5, 10, 10, 10.4, 11, 15, 20, 30]
M = [0, 1, 0, 0, 1, 1, 0, 1, 0, 1]
C = [0, 1, 0, 1, 1, 0, 0, 1, 0, 1]


def tape(spark, n=10):
    rows = [(0, k, int(t * S), m, c, 0, m + 2 * c) for k, (t, m, c) in enumerate(zip(T[:n], M[:n], C[:n]))]
    return spark.createDataFrame(rows, "seg long, seq long, t_ns long, m int, c int, s int, e int")


def steps(spark):
    return spark.createDataFrame([(0, 0, 0), (0, 8 * S, 1), (0, 16 * S, 0)], "seg long, t_ns long, s int")


def test_trailing_count_is_causal_where_times_tie(spark):
    out = tape(spark).withColumn("n", q.trailing_count(F.col("m") == 1, S, ["seg"]))
    n = {r.seq: r.n for r in out.collect()}
    assert (n[3], n[4]) == (0, 1)
    prefix = tape(spark, 5).withColumn("n", q.trailing_count(F.col("m") == 1, S, ["seg"]))
    assert {r.seq: r.n for r in prefix.collect()} == {k: n[k] for k in range(5)}


def test_asof_takes_a_step_at_the_same_time(spark):
    events = spark.createDataFrame([(0, 1, 8 * S), (0, 2, 8 * S - 1), (1, 3, 5)], "seg long, seq long, t_ns long")
    out = q.asof_backward(events, steps(spark), ["seg"], "s", default=9)
    assert {r.seq: r.s for r in out.collect()} == {1: 1, 2: 0, 3: 9}


def test_pieces_tile_time(spark):
    out = q.split_intervals(tape(spark), steps(spark), ["seg"], 40 * S)
    assert out.agg(F.sum(F.col("u1_ns") - F.col("u0_ns"))).first()[0] == 40 * S
    cut = q.clip_pieces(out, S, 31 * S, 7 * S)
    assert cut.agg(F.sum(F.col("u1_ns") - F.col("u0_ns"))).first()[0] == 30 * S
    assert {r.block for r in cut.select("block").distinct().collect()} == set(range(5))


def fills(spark, rows):
    schema = "symbol long, capture_seq long, timestamp_ns long, aggressor string, price double, quantity double, trade_id long"
    return spark.createDataFrame([(0, k, t, side, p, 1.0, k) for k, (t, side, p) in enumerate(rows)], schema)


def test_collapse_rules(spark):
    rows = [(0, "buy", 1.0), (0, "buy", 2.0), (0, "sell", 2.0), (5, "sell", 2.0), (4, "sell", 3.0), (6, "sell", 3.0)]
    out = sorted((r.fills, r.levels, r.price_first, r.price_last) for r in q.collapse(fills(spark, rows), ["symbol"]).collect())
    # The first fill joins its run; a step back in time does not end one.
    assert out == [(1, 1, 2.0, 2.0), (1, 1, 3.0, 3.0), (2, 2, 1.0, 2.0), (2, 2, 2.0, 3.0)]
    assert q.collapse(fills(spark, rows), ["symbol"], merge_gap_ns=5).count() == 2
    assert q.collapse(fills(spark, rows).filter("false"), ["symbol"]).count() == 0


def test_continuity_of_nothing_and_one(spark):
    one = spark.createDataFrame([(0, 1, 5, 7)], "symbol long, capture_seq long, first_seq long, last_seq long")
    assert q.continuity(one, ["symbol"]).first().continuous
    two = spark.createDataFrame([(0, 1, 5, 7), (0, 2, 9, 9)], one.schema)
    assert not q.continuity(two, ["symbol"]).first().continuous
    assert [r.segment for r in q.segments(two, ["symbol"]).orderBy("capture_seq").collect()] == [0, 1]


def test_book_last_write_wins_and_joins_agree(spark):
    rows = [(0, 1, 0, "bid", 10.0, 1.0), (0, 1, 1, "bid", 10.0, 3.0), (0, 1, 2, "ask", 11.0, 2.0), (0, 2, 0, "bid", 10.0, 0.0), (0, 2, 1, "bid", 9.0, 4.0), (0, 3, 0, "ask", 8.0, 1.0)]
    levels = spark.createDataFrame(rows, "symbol long, update long, pos long, side string, price double, quantity double")
    out = {r.update: r for r in book.replay(levels, ["symbol"]).collect()}
    assert (out[1].best_bid, out[1].bid_depth, out[2].best_bid, out[3].crossed) == (10.0, 3.0, 9.0, True)
    joined = {r.update: r for r in book.features_of(book.snapshot_at(levels, ["symbol"], levels.select("symbol", "update").distinct()), ["symbol"]).collect()}
    assert all(joined[u].best_bid == out[u].best_bid and joined[u].imb5 == out[u].imb5 for u in out)
    first = spark.createDataFrame([(0, "bid", 10.5, 1.0)], "symbol long, side string, price double, quantity double")
    assert book.replay(levels, ["symbol"], snapshot=first).filter("update = 1").first().best_bid == 10.5


def test_excitation_matches_brute_force_and_chunks(spark):
    beta = np.array([0.5, 2.0])
    t, e = np.array(T), np.array(M) + 2 * np.array(C)
    whole = {r.seq: np.array(r.R) for r in hawkes.excitation(tape(spark), ["seg"], beta, 4, S).collect()}
    parts = {r.seq: np.array(r.R) for r in hawkes.excitation(tape(spark), ["seg"], beta, 4, S, chunk_ns=4 * S).collect()}
    for k in range(len(t)):
        brute = np.array([[sum(np.exp(-b * (t[k] - t[i])) for i in range(k) if e[i] == j) for j in range(4)] for b in beta]).ravel()
        assert np.allclose(whole[k], brute, atol=1e-12) and np.allclose(parts[k], brute, atol=1e-12)


def test_likelihood_is_additive_and_fit_rises(spark):
    m = hawkes.model([[0.1, 0.2], [0.3, 0.1]], [[[0.1] * 4, [0.2] * 4]], [1.0], S)
    x = hawkes.excitation(tape(spark), ["seg"], [1.0], 4, S)
    ll = lambda a, b: hawkes.log_likelihood(x, hawkes.state_pieces(steps(spark), x, ["seg"], a * S, b * S), m, ["seg"], a * S, b * S).first().loglik
    assert abs(ll(1, 31) - ll(1, 9) - ll(9, 31)) < 1e-9
    cells = hawkes.state_pieces(steps(spark), x, ["seg"], 0, 31 * S)
    fitted, trace = hawkes.fit_pooled(x, cells, (2, 2, 1, 4), [1.0], 0, 31 * S, S, tolerance=1e-6)
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))
    assert abs(hawkes.log_likelihood(x, cells, fitted, ["seg"], 0, 31 * S).first().loglik - trace[-1]) < 1e-6
    with pytest.raises(RuntimeError, match="did not converge"):
        hawkes.fit_pooled(x, cells, (2, 2, 1, 4), [1.0], 0, 31 * S, S, rounds=2)
    assert m.branching().shape == (2, 4) and np.isnan(m.spectral_radius()) and m.fold_side().shape == (2, 2)


def test_residuals_sum_to_the_compensator(spark):
    m = hawkes.model([[0.1, 0.2], [0.3, 0.1]], [[[0.1] * 4, [0.2] * 4]], [1.0], S)
    x = hawkes.excitation(tape(spark), ["seg"], [1.0], 4, S)
    pieces = q.split_intervals(tape(spark), steps(spark), ["seg"], 40 * S)
    last = hawkes.cumulative(x, pieces, m, ["seg"]).orderBy(F.desc("t_ns")).first()
    area = {r.m: r.compensator for r in hawkes.compensator(x.filter("seq < 9"), hawkes.state_pieces(steps(spark), x, ["seg"], 0, 30 * S), m, ["seg"], 0, 30 * S).collect()}
    assert abs(last.area0 - area[0]) < 1e-9 and abs(last.area1 - area[1]) < 1e-9


def test_bootstrap_of_equal_blocks_has_no_width(spark):
    blocks = spark.createDataFrame([(0, b, 2.0, 4) for b in range(5)], "g int, block long, gain double, events long")
    r = inference.block_bootstrap(blocks, ["g"], 50).first()
    assert (r.estimate, r.low, r.high) == (0.5, 0.5, 0.5)


def test_empty_bins_and_ks(spark):
    x = spark.createDataFrame([(0, 1.0, 0.5)], "g int, x double, c double")
    out = {r.bin: (r.n, r.mean, r.se) for r in a.conditional_means(x, ["g"], "x", "c", (1, 2)).collect()}
    assert out == {0: (1, 1.0, None), 1: (0, None, None), 2: (0, None, None)}
    assert abs(a.ks_exponential(x, ["g"], "x").first().ks - (1 - np.exp(-1))) < 1e-12


def test_blocks_and_prefix(spark):
    assert q.block_edges(0, 25, 10) == [0, 10, 20] and q.block_edges(5, 25, None) == [5]
    assert q.before(tape(spark), 10 * S).count() == 3
    out = tape(spark).select("seq", q.block_of(F.col("t_ns"), [0, 10 * S, 20 * S]).alias("b"))
    assert [r.b for r in out.orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 2, 2]


def test_capture_and_run(spark, tmp_path):
    folder = c.partition_path(str(tmp_path), "abc", "2024-01-01")
    rows = fills(spark, [(0, "buy", 1.0), (0, "buy", 2.0), (9, "sell", 2.0)]).withColumn("price", F.col("price").cast("decimal(38,18)"))
    for name in ("trades-7", "features-7"):
        rows.coalesce(1).toPandas().to_parquet(f"{_made(folder)}/{name}.parquet")
    assert [(r.stream, r.session) for r in c.session_files(spark, folder).collect()] == [("trades", 7)]
    assert c.has_stream(spark, folder, "trades") and not c.has_stream(spark, folder, "snapshots")
    loaded = c.load_capture(spark, folder)
    assert sorted(loaded) == ["orders", "trades"] and loaded["orders"].count() == 2
    times = c.exact_fingerprint(rows, ["symbol"]).first().fingerprint
    assert times == hashlib.sha256(np.array([0, 0, 9], np.int64).tobytes()).hexdigest()[:16]
    run = c.Run(spark, str(tmp_path / "run"))
    run.config({"fingerprint": times})
    run.curve(1, 0.5, 0.6, 1.0)
    assert run.resume() is None
    run.checkpoint(1, {"w": [1.0]}, 0.6, 0)
    run.checkpoint(2, {"w": [2.0]}, 0.5, 0)
    assert run.resume()["epoch"] == 2 and run.verify({"fingerprint": times}) is None and run.verify({"fingerprint": "x"})


def _made(folder):
    os.makedirs(folder, exist_ok=True)
    return folder


def test_registry_and_report(spark, tmp_path):
    kinds = "session string, fingerprint string, role string"
    registry = spark.createDataFrame([("a", "f1", "replication"), ("x", "f9", "exploratory")], kinds)
    new = spark.createDataFrame([("b", "f1", "replication"), ("c", "f2", "replication"), ("d", "f2", "replication")], kinds)
    assert [r.fingerprint for r in c.register(registry, new).collect()] == ["f2"]
    results = spark.createDataFrame([("z",)], "session string")
    assert c.final_test_allowed(registry, results, "a") and not c.final_test_allowed(registry, results, "x") and not c.final_test_allowed(registry, results.unionByName(registry.select("session")), "a")
    assert not c.final_test_allowed(registry, results, "a", barred=("a",))
    gains = spark.createDataFrame([("M1", 0.1, 0.05, 0.2)], "model string, estimate double, low double, high double")
    text = c.report(inference.verdicts(gains), spark.createDataFrame([("shift", 0.0, None, 1)], "control string, mean double, sd double, runs int"))
    assert "| M1 | 0.1000 | 0.0500 | 0.2000 | supported |" in text and "| shift | 0.0000 | 0.0000 | 1 |" in text
    ks = spark.createDataFrame([("M4", 0, 0.05, 0.02)], "model string, m int, ks double, null_ks double")
    assert "| M4 | 0 | 0.0500 | 0.0200 |" in c.report(inference.verdicts(gains), spark.createDataFrame([], "control string, mean double, sd double, runs int"), ks)
    path = str(tmp_path / "cached")
    assert c.cached(spark, path, lambda: results).count() == 1 and c.cached(spark, path, lambda: 1 / 0).count() == 1


def test_identity_and_facts(spark, tmp_path):
    rows = fills(spark, [(0, "buy", 1.0), (100 * S, "buy", 2.0), (200 * S, "sell", 2.0)])
    data = c.data_identity(rows, ["symbol"])
    r = data.first()
    assert (r.rows, r.first_ns, r.last_ns, r.train_end, r.val_end) == (3, 0, 200 * S, 140.0, 170.0) and len(r.fingerprint) == 16
    run = c.Run(spark, str(tmp_path / "run"))
    run.config({"seed": 1}, "abc", data)
    assert run.verify({"seed": 1, "revision": "abc"}, data) is None
    other = c.data_identity(rows.filter("capture_seq < 2"), ["symbol"])
    assert "data" in run.verify({"seed": 1}, other)
    orders = q.orders(rows, ["symbol"])
    going = spark.createDataFrame([(0, True)], "symbol long, continuous boolean")
    seeds, none = spark.createDataFrame([(0, 5)], "symbol long, last_seq long"), spark.createDataFrame([], "symbol long, last_seq long")
    facts = lambda **more: a.eligibility(orders, going, ["symbol"], 100, 2, **more).first()
    full = facts(snapshots=seeds, book=seeds.unionByName(seeds), fingerprints=data)
    assert (full.eligible, full.snapshots, full.book_rows, full.fingerprint) == (True, 1, 2, r.fingerprint)
    assert not facts(snapshots=none).eligible and facts().eligible
    back = q.backfilled(spark.createDataFrame([(0, 50, 2), (0, 60, 1), (1, 0, 1)], "seg long, t_ns long, s int"), ["seg"], 0)
    assert sorted(tuple(x) for x in back.collect()) == [(0, 0, 2), (0, 50, 2), (0, 60, 1), (1, 0, 1)]


def test_baseline_blocks_and_extrapolation(spark):
    mu = [[0.1, 0.2], [0.3, 0.1], [0.4, 0.2], [0.2, 0.5]]  # two blocks of two states
    m = hawkes.model(mu, np.zeros((1, 2, 4)), [1.0], S, [10 * S])
    cells = hawkes.state_pieces(steps(spark), tape(spark), ["seg"], 0, 31 * S)
    area = {r.m: r.compensator for r in hawkes.compensator(tape(spark), cells, m, ["seg"], 0, 31 * S).collect()}
    # States: 0 until 8 s, 1 until 16 s, then 0; blocks change at 10 s.
    want = [8 * mu[0][i] + 2 * mu[1][i] + 6 * mu[3][i] + 15 * mu[2][i] for i in (0, 1)]
    assert np.allclose([area[0], area[1]], want)
    time = hawkes.block_time(cells, m)
    assert np.allclose(time, [[8, 2], [15, 6]])
    after = hawkes.extrapolate(m, time, 31 * S)
    assert np.allclose(after.mu[4], [(8 * mu[0][i] + 15 * mu[2][i]) / 23 for i in (0, 1)]) and np.allclose(after.mu[5], [(2 * mu[1][i] + 6 * mu[3][i]) / 8 for i in (0, 1)])
    flat = hawkes.poisson_fit(tape(spark), cells, 2, 2, 4, 0, 31 * S, S, (10 * S,))
    assert abs(hawkes.log_likelihood(hawkes.excitation(tape(spark), ["seg"], [1.0], 4, S), cells, flat, ["seg"], 0, 31 * S).first().events - 10) == 0


def test_ranks_by_ranges(spark):
    from propago.operators import summary

    rows = [(g, float((7 * k * k + g) % 101), k) for g in (0, 1) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, x double, k long")
    near = lambda a, b: all(np.isclose(x, y, equal_nan=True) for u, v in zip(a, b) for x, y in zip(u, v))
    of = lambda d: sorted(tuple(r) for r in d.collect())
    assert near(of(summary.ks_exponential(df, ["g"], "x")), of(summary.ks_exponential(df, ["g"], "x", large=True)))
    assert near(of(summary.exponential_quantiles(df, ["g"], "x")), of(summary.exponential_quantiles(df, ["g"], "x", large=True)))
    lags = (1, 2, 5)
    assert near(of(summary.autocorrelation(df, ["g"], "x", ["k"], lags)), of(summary.autocorrelation(df, ["g"], "x", ["k"], lags, block=7)))


def test_excitation_streams_many_short_and_few_long_series(spark):
    """Batches of some rows: series side by side and one by one, handed on between batches and time chunks, equal plain sums."""
    r, hour = np.random.default_rng(3), 10**9
    rows = [(g, n, int(t), int(r.integers(-1, 3))) for g, size in enumerate([700, 1, 3, *[9] * 40]) for n, t in enumerate(np.sort(r.integers(-50, 200, size)) * hour)]
    tape = spark.createDataFrame(rows, "seg long, seq long, t_ns long, e int").withColumn("seg", F.when(F.col("seg") == 5, None).otherwise(F.col("seg")))
    expected = {}
    for g in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == g]
        for _, n, t, _ in own:
            sums = [[sum(np.exp(-b * (t - y[2]) / hour) for y in own[:n] if y[3] == j) for j in range(3)] for b in (0.02, 3.0)]
            expected[None if g == 5 else g, n] = np.ravel(sums)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 100, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for chunk in (None, 17 * hour):
                found = {(x.seg, x.seq): x.R for x in hawkes.excitation(tape, ["seg"], (0.02, 3.0), 3, hour, chunk).collect()}
                assert found.keys() == expected.keys()
                assert all(np.allclose(found[x], expected[x], atol=1e-9) for x in found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_large_tables_are_dealt_to_more_tasks_by_series(spark, monkeypatch):
    """A task gets TASK_ROWS rows on average at most, whatever the session's number of partitions, in one shuffle."""
    from propago import session

    plain = v.fills(spark, SF).count()
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    fills = v.fills(spark, SF)
    assert fills.rdd.getNumPartitions() >= plain / 500 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = q.collapse(fills, ["symbol"])
    assert orders.rdd.getNumPartitions() == fills.rdd.getNumPartitions()
    assert fills.count() == plain and orders.agg({"fills": "sum"}).first()[0] == plain


def test_tables_are_dealt_where_the_session_has_many_partitions(spark, monkeypatch):
    """Adaptive execution does not merge what is dealt, however many partitions the session asks for."""
    from propago import session

    plain = v.fills(spark, SF).count()
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(plain))
        orders = q.collapse(v.fills(spark, SF), ["symbol"])
        assert orders.rdd.getNumPartitions() >= plain / 500
        assert v.level_updates(spark, SF).rdd.getNumPartitions() >= plain / 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
