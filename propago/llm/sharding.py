"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propago.session import cut

#: Prefix bits that one round over the still oversized buckets adds; a bucket has 2**BITS cells at most in a round.
BITS = 12
_DIGITS = BITS // 4
#: Hex digits of a row's hash: rounds end there, with rows that are equal throughout.
_HASH = 30


def _hash(columns: list[Column], everything: list[Column]) -> Column:
    """Hex digits: half from the key, so that rows of a key stay together as long as they fit, half from the whole row."""
    text = lambda cs: F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cs))
    return F.concat(F.substring(F.md5(text(columns)), 1, _HASH // 2), F.substring(F.md5(text(everything)), 1, _HASH // 2))


def _round(active: DataFrame, at: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (parent, chunk, depth, shard_id, shard_bytes, same) of the cells that fit, and the cells that do not."""
    cells = active.groupBy(F.substring("hex", 1, at).alias("parent"), F.conv(F.substring("hex", at + 1, _DIGITS), 16, 10).cast("int").alias("chunk"))
    cells = cut(cells.agg(F.sum("size").alias("bytes"), F.sum("n").alias("n"), F.min("hex").alias("low"), F.max("hex").alias("high")))
    paths = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(BITS)))).withColumn("prefix", F.expr(f"shiftright(chunk, {BITS} - depth)"))
    levels = paths.groupBy("parent", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    over = levels.withColumn("over", (F.col("bytes") > limit) & (F.col("low") != F.col("high")))
    on_path = paths.select("parent", "chunk", "depth", "prefix").join(over, ["parent", "depth", "prefix"])
    # Oversized buckets are nested, so the first that fits is the leaf.
    leaf = on_path.filter("NOT over").groupBy("parent", "chunk").agg(F.min_by(F.struct("depth", "prefix", "bytes", "n", "low", "high"), "depth").alias("leaf"))
    every = cells.select("parent", "chunk").join(leaf, ["parent", "chunk"], "left")
    parent_bits = F.concat(F.lit(""), *(F.lpad(F.conv(F.substring("parent", i + 1, 1), 16, 2), 4, "0") for i in range(at)))
    shard = F.concat(parent_bits, F.expr(f"right(lpad(bin(leaf.prefix), {BITS}, '0'), leaf.depth)"))
    leaves = every.filter("leaf IS NOT NULL").select(
        "parent", "chunk", (F.lit(4 * at) + F.col("leaf.depth")).alias("depth"), shard.alias("shard_id"), F.col("leaf.bytes").alias("shard_bytes"),
        ((F.col("leaf.bytes") > limit) & (F.col("leaf.n") > 1)).alias("same"),
    )
    return leaves, every.filter("leaf IS NULL").select("parent", "chunk")


def shard(df: DataFrame, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append ``shard_id`` (prefix bits; "" is the whole table), ``shard_depth`` (int) and ``shard_bytes`` (long).

    A row's bytes are those of its text in UTF-8; null: 0. The directory starts with one bucket; a bucket over ``limit``
    bytes splits on the next bit, until every shard fits. Rows that are equal in every column cannot be told apart by
    bits: a bucket of those over the limit is paged, "#0", "#1" and so on after its bits. A row over the limit has a
    shard of its own, whose shard_bytes shows it. Null keys hash like any value; an empty table gives no rows. Input
    columns named like an output are replaced.
    """
    outputs = ("shard_id", "shard_depth", "shard_bytes")
    columns = [F.col(f"`{c}`") for c in df.columns if c not in outputs]
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    # Rows go as structs, so that no column of theirs can clash.
    rows = df.select(F.struct(*columns).alias("__row"), _hash([F.col(f"`{key}`")], columns).alias("__hex"), size.alias("__size"))
    active = cut(rows.groupBy(F.col("__hex").alias("hex")).agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n")))
    found = None
    for at in range(0, _HASH, _DIGITS):
        leaves, over = _round(active, at, limit)
        leaves = cut(leaves)
        parent, chunk = F.substring("hex", 1, at), F.conv(F.substring("hex", at + 1, _DIGITS), 16, 10).cast("int")
        placed = active.withColumns({"parent": parent, "chunk": chunk}).join(leaves, ["parent", "chunk"]).select("hex", "n", "depth", "shard_id", "shard_bytes", "same")
        found = placed if found is None else found.unionByName(placed)
        over = cut(over)
        if over.isEmpty():
            break
        active = cut(active.withColumns({"parent": parent, "chunk": chunk}).join(over, ["parent", "chunk"], "left_semi").select("hex", "size", "n"))
    given = rows.join(found.withColumnRenamed("hex", "__hex"), "__hex")
    out = [F.col("shard_id"), F.col("depth").cast("int").alias("shard_depth"), F.col("shard_bytes").cast("long")]
    plain = given.filter(~F.col("same")).select("__row.*", *out)
    if found.filter("same").isEmpty():
        return plain
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__size", F.lit(1)))).cast("long")
    equal = given.filter("same").groupBy("__row", "__size", "shard_id", "depth").agg(F.count(F.lit(1)).alias("copies")).withColumn("per_page", per_page)
    paged = equal.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("page", F.floor(F.col("copy") / F.col("per_page")))
    on_page = F.least("per_page", F.col("copies") - F.col("page") * F.col("per_page"))
    return plain.unionByName(
        paged.select("__row.*", F.concat("shard_id", F.lit("#"), "page").alias("shard_id"), F.col("depth").cast("int").alias("shard_depth"), (on_page * F.col("__size")).cast("long").alias("shard_bytes"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each written by one task."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
