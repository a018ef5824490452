"""Capture folders and streams, written from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from propago.plans.registry import query
from propago.plans.sequence_queries import DAY, HOUR, tape
from propago.sources import capture as c
from propago.sources import views as v
from propago.streaming import tape as s

_HALVES_SQL = v.FILLS_SQL + ", halves AS (SELECT *, symbol % 16 AS session FROM fills)"


SESSIONS = 16


def _folder(spark, sf_dir) -> str:
    """Sessions of trades as capture files, one a session."""
    folder = c.partition_path(c.scratch(spark, "capture"), "abc", "2024-01-01")
    trades = v.fills(spark, sf_dir).withColumn("session", F.col("symbol") % SESSIONS)
    trades.repartition("session").write.partitionBy("session").parquet(f"{folder}/parts")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for session in range(SESSIONS):
        source = jvm.Path(f"{folder}/parts/session={session}")
        fs = source.getFileSystem(conf)
        for f in fs.listStatus(source) if fs.exists(source) else ():
            if f.getPath().getName().endswith(".parquet"):
                fs.rename(f.getPath(), jvm.Path(f"{folder}/trades-{session}.parquet"))
    parts = jvm.Path(f"{folder}/parts")
    parts.getFileSystem(conf).delete(parts, True)
    return folder


@query(_HALVES_SQL + " SELECT session, count(*) AS n, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM halves GROUP BY session")
def capture_scan(spark, sf_dir):
    """Sessions come from the file names."""
    folder = _folder(spark, sf_dir)
    rows = c.scan_stream(spark, folder, "trades")
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


@query(
    v.FILLS_SQL
    + """, hashed AS (SELECT symbol, sha256(capture_seq || ':' || timestamp_ns) AS h FROM fills),
sums AS (SELECT symbol, sum(('0x' || h[1:12])::BIGINT)::HUGEINT AS a, sum(('0x' || h[13:24])::BIGINT)::HUGEINT AS b, count(*) AS n FROM hashed GROUP BY symbol)
SELECT symbol, sha256(a || ':' || b || ':' || n)[1:16] AS fingerprint FROM sums"""
)
def session_fingerprints(spark, sf_dir):
    return c.fingerprint(v.fills(spark, sf_dir), ["symbol"])


@query()
def exact_fingerprints(spark, sf_dir):
    return c.exact_fingerprint(v.fills(spark, sf_dir), ["symbol"])


@query(v.RAW_TAPE_SQL + f" SELECT seg, m, t_ns // {DAY} AS day, count(*) AS n FROM raw_tape GROUP BY ALL")
def streamed_counts(spark, sf_dir):
    """Daily counts by Structured Streaming over files, all that are there."""
    at = c.scratch(spark, "stream")
    v.raw_tape(spark, sf_dir).repartitionByRange(3, "t_ns").sortWithinPartitions("t_ns").write.parquet(f"{at}/in")
    stream = s.read_tape(spark, f"{at}/in", "seg long, seq long, t_ns long, m int, c int", 10)
    out = _complete(stream, at)
    return out.select("seg", "m", (F.unix_micros("start") * 1000 / F.lit(DAY)).cast("long").alias("day"), "n")


def _complete(stream, at):
    """Each trigger writes the counts so far, by all tasks; the last ones are read."""
    counts = s.windowed_counts(stream, "1 day", late="400 days").writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state")
    counts.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{at}/out/{number:06d}")).trigger(availableNow=True).start().awaitTermination()
    folder = stream.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    fs = folder.getFileSystem(stream.sparkSession._jsc.hadoopConfiguration())
    return stream.sparkSession.read.parquet(max(f.getPath().toString() for f in fs.listStatus(folder)))


@query(
    v.TAPE_SQL
    + """, pairs AS (SELECT t.seg, t.seq, sum(exp(-0.05 * (t.t_ns - x.t_ns) / 3.6e12)) AS total FROM tape t JOIN tape x ON x.seg = t.seg AND (x.t_ns < t.t_ns OR (x.t_ns = t.t_ns AND x.seq < t.seq)) GROUP BY ALL)
SELECT t.seg, t.seq, round(coalesce(total, 0), 6) AS total FROM tape t LEFT JOIN pairs USING (seg, seq)"""
)
def streamed_decayed_counts(spark, sf_dir):
    """Decayed counts with one vector of state a series."""
    at = c.scratch(spark, "stream")
    # A series is in one file, in order, so that its events come in order whatever the order of files.
    tape(spark, sf_dir).repartition("seg").sortWithinPartitions("seg", "t_ns", "seq").write.parquet(f"{at}/in")
    stream = s.read_tape(spark, f"{at}/in", "seg long, seq long, t_ns long, m int, c int, s int, e int", 10)
    out = s.run_once(s.decayed_counts(stream, [0.05], 24, HOUR), f"{at}/out", f"{at}/state")
    return out.select("seg", "seq", F.round(F.aggregate("R", F.lit(0.0), lambda x, y: x + y), 6).alias("total"))
