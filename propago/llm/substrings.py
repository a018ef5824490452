"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are dealt to blocks of contiguous doc_id ranges. A block sends each distinct window hash once, packed by hash
bucket, so that a passage in a third of all documents costs one entry a block. A bucket finds the first block of each
hash and tells later blocks which of theirs were seen; a block settles the rest among its own documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from propago.llm.blocks import NULLS_LAST, range_block

#: The polynomial's base; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
WINDOW = 13
BLOCK_DOCS = 512
BUCKET_WINDOWS = 1 << 20
#: A block's number has this many low bits for its part: blocks of one key's many rows are dealt to parts.
SALT_BITS = 20
#: Keys with over two blocks of rows that are dealt to parts; more such keys keep a block each.
MOST_KEYS = 1_000
#: Hashes that a task gathers before it packs them.
FLUSH = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, as many as n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """The Rabin-Karp hash of every window, by prefix sums; well mixed so that its high bits can choose a bucket."""
    n = len(words)
    if n < window:
        return np.empty(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    codes = np.fromiter(map(h, words), np.uint64, n)
    up, down = _base_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up, out=sums[1:])
    x = (sums[window:] - sums[:-window]) * down[: n - window + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def pack(x: np.ndarray) -> bytes:
    """Sorted hashes by byte planes: their first bytes repeat, which the shuffle's compression uses."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True, as (start, stop)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_PACKED = "bucket int, block long, hashes binary"


def _pack_blocks(window: int, n_buckets: int, text_at: int):
    edges = ((np.arange(1, n_buckets, dtype=object) << 64) // n_buckets).astype(np.uint64)

    def flush(block, held):
        x = np.unique(np.concatenate(held))
        cuts = [0, *np.searchsorted(x, edges).tolist(), len(x)]
        rows = [(i, pack(x[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["bucket", "block", "hashes"],
        )

    def run(batches):
        block, held, size = None, [], 0
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            for b, text in zip(batch.column(batch.num_columns - 1).to_pylist(), texts):
                if held and (b != block or size >= FLUSH):
                    yield flush(block, held)
                    held, size = [], 0
                block = b
                x = window_hashes((text.as_py() or b"").split(), window)
                if len(x):
                    held.append(x)
                    size += len(x)
        if held:
            yield flush(block, held)

    return run


def _seen_earlier(_, table):
    """Of one bucket's hashes, those of each block that an earlier block has too."""
    blocks = table.column("block").to_numpy()
    parts = [unpack(x.as_py()) for x in table.column("hashes")]
    owner = np.repeat(blocks, [len(x) for x in parts])
    x = np.concatenate(parts)
    order = np.lexsort((owner, x))
    x, owner = x[order], owner[order]
    first = np.concatenate(([True], x[1:] != x[:-1]))
    key_block = owner >> SALT_BITS
    again = key_block > key_block[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))]
    x, owner = x[again], owner[again]
    order = np.argsort(owner, kind="stable")
    x, owner = x[order], owner[order]
    found, at = np.unique(owner, return_index=True)
    return pa.table({"block": pa.array(found, pa.int64()), "hashes": pa.array([pack(p) for p in np.split(x, at[1:])] if len(x) else [], pa.binary())})


def _clean(window: int, n_kept: int, names: list[str], text_at: int):
    def run(_, docs, seen):
        keys = docs.column("__key").to_numpy()
        words = [(t.as_py() or b"").split() for t in docs.column(text_at).cast(pa.binary())]
        hashes = [window_hashes(w, window) for w in words]
        sizes = [len(x) for x in hashes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(keys, sizes)
        order = np.lexsort((owner, flat))
        x, k = flat[order], owner[order]
        first = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.empty(0, bool)
        later = k > k[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))]
        if seen.num_rows:
            old = np.unique(np.concatenate([unpack(s.as_py()) for s in seen.column("hashes")]))
            later |= old[np.minimum(np.searchsorted(old, x), len(old) - 1)] == x
        repeated = np.empty(len(x), bool)
        repeated[order] = later
        n_removed, texts, cuts = [], [], []
        for w, hit in zip(words, np.split(repeated, np.cumsum(sizes)[:-1])):
            mask = covered(np.flatnonzero(hit), len(w), window)
            n_removed.append(int(mask.sum()))
            texts.append(b" ".join(w if not n_removed[-1] else [x for x, gone in zip(w, mask.tolist()) if not gone]))
            cuts.append([{"start": a, "stop": b} for a, b in intervals(mask)])
        return pa.Table.from_arrays(
            [
                *(docs.column(i) for i in range(n_kept)),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ],
            names=names,
        )

    return run


def remove_repeats(
    df: DataFrame, window: int = WINDOW, key: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, bucket_windows: int = BUCKET_WINDOWS
) -> DataFrame:
    """Remove the words that repeat a window of an earlier document.

    Words are runs of bytes other than ASCII white space. A word goes if a window that covers it, of ``window``
    consecutive words, also starts in a row with a smaller ``key``; windows are judged on the input. Appends
    ``n_words``, ``n_removed`` (long), ``kept_text`` (words joined by a space) and ``removed`` (maximal intervals
    [start, stop) of word positions). Input columns of those names are replaced; others pass through.

    Null texts have no words. Texts shorter than a window lose none. Rows of equal key never remove each other's words;
    null keys count as the largest key. An empty table gives an empty result. Windows are told apart by 64-bit hashes:
    n distinct windows hold a false repeat with a chance of about n*n / 2**65.
    """
    added = [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("kept_text", StringType()),
        StructField("removed", ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))),
    ]
    kept = [c for c in df.columns if c not in {f.name for f in added}]
    schema = StructType([*(StructField(c, StringType()) if c == text_col else df.schema[c] for c in kept), *added])
    # A key with many rows has a block to itself, in which no row removes another's words: its rows may go to any part.
    ordered = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULLS_LAST))
    often = df.groupBy(ordered.alias("k")).count().filter(F.col("count") > 2 * block_docs).orderBy(F.desc("count")).limit(MOST_KEYS).collect()
    block, _, _ = range_block(df, key, block_docs, tuple(r.k for r in often))
    salt = F.lit(0)
    if often:
        parts_of = F.create_map(*(F.lit(x) for r in often for x in (r.k, min(-(-r["count"] // block_docs), 1 << SALT_BITS))))
        salt = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.try_element_at(parts_of, ordered), F.lit(1)))
    block = block.cast("long") * (1 << SALT_BITS) + salt
    size = df.select(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    n_buckets = max(1, size // (6 * bucket_windows))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (16 << 20))
    # Both steps read all columns, so that Spark makes one shuffle of the texts and reads it twice.
    text = F.col(f"`{text_col}`").cast("string")
    # Columns go by position, so that no name of theirs can clash.
    kept_columns = [(text if c == text_col else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(kept)]
    text_at = kept.index(text_col) if text_col in kept else len(kept)
    spare = [] if text_col in kept else [text.alias("__text")]
    docs = df.select(*kept_columns, *spare, ordered.alias("__key"), block.cast("long").alias("__block")).repartition(parts, "__block")
    packed = docs.mapInArrow(_pack_blocks(window, n_buckets, text_at), _PACKED)
    seen = packed.groupBy("bucket").applyInArrow(_seen_earlier, "block long, hashes binary")
    return docs.groupBy("__block").cogroup(seen.groupBy("block")).applyInArrow(_clean(window, len(kept), [f.name for f in schema], text_at), schema)
