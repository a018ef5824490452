"""Streams give what the batch operators give, over several micro-batches."""

from pyspark.sql import functions as F

from propago.operators import book
from propago.streaming import tape as s

DAY = 86_400_000_000_000


def test_gaps_across_batches(spark, tmp_path):
    rows = [(0, 1, 1, 3), (0, 2, 4, 4), (0, 3, 6, 9), (1, 1, 5, 5), (1, 2, 6, 6)]
    for k, part in enumerate((rows[:1] + rows[3:4], rows[1:3] + rows[4:])):
        spark.createDataFrame(part, "symbol long, capture_seq long, first_seq long, last_seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol long, capture_seq long, first_seq long, last_seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = s.run_once(s.sequence_gaps(stream), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [tuple(r) for r in out] == [(0, 3, 5, 6)]


def test_repeated_trades_are_dropped(spark, tmp_path):
    rows = [(0, k, k * DAY // 100, 0, 0) for k in (1, 2, 2, 3, 1)]
    schema = "seg long, seq long, t_ns long, m int, c int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = s.read_tape(spark, str(tmp_path / "in"), schema)
    out = s.run_once(s.distinct_trades(stream, "seq", "2 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.seq for r in out.select(F.col("seq")).collect()) == [1, 2, 3]


def test_book_goes_on_across_batches(spark, tmp_path):
    """Stale updates go, gaps are counted, levels live on in the state; the rest is as in the batch replay."""
    kinds = "symbol long, update long, first_seq long, last_seq long, pos long, side string, price double, quantity double"
    first = [(0, 1, 1, 1, 0, "bid", 10.0, 1.0), (0, 1, 1, 1, 1, "ask", 11.0, 2.0), (1, 1, 5, 6, 0, "bid", 3.0, 1.0), (0, 2, 2, 3, 0, "bid", 10.0, 0.0), (0, 2, 2, 3, 1, "bid", 9.0, 4.0)]
    second = [(0, 3, 3, 3, 0, "bid", 50.0, 9.0), (0, 4, 4, 4, 0, "ask", 10.5, 1.0), (1, 2, 9, 9, 0, "ask", 4.0, 2.0), (1, 3, 10, 10, 0, "bid", 3.0, 0.0)]
    for part in (first, second):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {(r.symbol, r.update): r for r in s.run_once(s.book_states(stream), str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    fresh = [x for x in first + second if x[:2] != (0, 3)]
    want = {(r.symbol, r.update): r for r in book.replay(spark.createDataFrame(fresh, kinds), ["symbol"]).collect()}
    assert sorted(out) == sorted(want) and {k: r.gaps for k, r in out.items()} == {(0, 1): 0, (0, 2): 0, (0, 4): 0, (1, 1): 0, (1, 2): 1, (1, 3): 1}
    assert all([out[k][c] for c in book.FEATURE_NAMES] == [want[k][c] for c in book.FEATURE_NAMES] for k in want)


def test_decayed_counts_go_on_across_batches_and_edges_excite_nothing(spark, tmp_path):
    from propago.operators import hawkes as h

    kinds = "seg long, seq long, t_ns long, m int, c int, s int, e int"
    first, second = ([(g, k, k // 2 * 10**9, 0, 0, 0, (k + g) % 4 - 1) for k in ks for g in (0, 1)] for ks in (range(6), range(6, 9)))
    for part in (first, second):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = s.run_once(s.decayed_counts(s.read_tape(spark, str(tmp_path / "in"), kinds), [0.5, 2.0], 3, 10**9), str(tmp_path / "out"), str(tmp_path / "state"))
    found = {(r.seg, r.seq): [round(x, 9) for x in r.R] for r in out.collect()}
    want = {(r.seg, r.seq): [round(x, 9) for x in r.R] for r in h.excitation(spark.createDataFrame(first + second, kinds), ["seg"], (0.5, 2.0), 3, 10**9).collect()}
    assert found == want and len(found) == 18
