"""SimHash near-dedup with a pigeonring filter before the full Hamming check."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from propago.llm.arrow import append_columns
from propago.llm.components import components
from propago.session import cut

SHINGLE = 4
SEED = 42
#: Segments of a fingerprint and the most bits in which linked ones differ: half a bit a segment.
SEGMENTS, BUDGET = 8, 4
WIDTH = 64 // SEGMENTS
#: Distinct fingerprints of one key that a task compares at once; larger groups are compared block by block.
BLOCK = 4096


def fingerprint_bits(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included: a bit is 1 if set in over half the hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    x = np.array([h(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(x), 1 << 16):  # bounded memory for very long texts
        part = x[at : at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Append ``fp`` (long): the bits of the SimHash as a signed number. Null or wordless texts have 0."""

    def make():
        def fn(texts):
            bits = np.array([fingerprint_bits(t or b"", shingle) for t in texts], np.uint64)
            return (pa.array(bits.view(np.int64), pa.int64()),)

        return fn

    return append_columns(df.withColumn("__bytes", F.col(f"`{text_col}`").cast("string")), {"__bytes": "binary"}, [StructField("fp", LongType())], make).drop("__bytes")


def chains(exact: int) -> list[tuple[int, ...]]:
    """The key patterns of the pigeonring filter: a start segment and ``exact - 1`` later ones, all equal.

    With a budget of half a bit a segment, two linked fingerprints have a start from which the first l segments of the
    ring differ in l/2 bits at most, for every l. So the start is equal; of the next two at least one is, of the next
    four at least two, of the next six at least three. A pattern has the first equal ones of such a chain.
    """
    later = [c for c in combinations(range(1, 2 * (exact - 1) + 1), exact - 1) if all(c[k] <= 2 * (k + 1) for k in range(exact - 1))]
    return [tuple((i + j) % SEGMENTS for j in (0, *c)) for i in range(SEGMENTS) for c in later]


def _keys(fp, exact: int):
    """An array of the keys of a fingerprint: the pattern's number and its segments' bits."""
    segment = lambda j: F.shiftrightunsigned(fp, WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1))
    out = []
    for number, pattern in enumerate(chains(exact)):
        key = F.lit(number).cast("long")
        for j in pattern:
            key = F.shiftleft(key, WIDTH).bitwiseOR(segment(j))
        out.append(key)
    return F.array(*out)


def chain_holds(diff: np.ndarray, start) -> np.ndarray:
    """Whether the first l segments of the ring from ``start`` differ in l/2 bits at most, for every l short of all."""
    turn = (np.asarray(start, np.uint64) * np.uint64(WIDTH)) & np.uint64(63)
    ring = (diff >> turn) | (diff << ((np.uint64(64) - turn) & np.uint64(63)))
    total, holds = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    for at in range(SEGMENTS - 1):
        total += np.bitwise_count((ring >> np.uint64(WIDTH * at)) & np.uint64((1 << WIDTH) - 1))
        holds &= total <= (at + 1) * BUDGET // SEGMENTS
    return holds


def linked(diff: np.ndarray, start) -> np.ndarray:
    """The pigeonring filter prunes first; the full Hamming distance decides on what it leaves."""
    out = chain_holds(diff, start)
    out[out] = np.bitwise_count(diff[out]) <= BUDGET
    return out


def spanning_links(values: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect each group of values that chains from ``start`` link: a breadth-first search's tree."""
    left = np.sort(values)
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = linked(left ^ x, start)
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
                left = left[~near]
    return out


def _compare(patterns_per_start: int, exact: int):
    """Compare the fingerprints of each unit (key, i, j); rows come sorted by unit."""

    def changes(whole) -> np.ndarray:
        key, i, j = (whole.column(c).to_numpy() for c in range(3))
        return np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            cuts = changes(whole)
            if len(cuts):
                yield from emit(whole.slice(0, int(cuts[-1])), cuts[:-1])
                held = whole.slice(int(cuts[-1])).combine_chunks().to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            yield from emit(whole, changes(whole))

    def emit(whole, cuts):
        if not whole.num_rows:
            return
        fps = whole.column(3).to_numpy().astype(np.int64).view(np.uint64)
        starts = (whole.column(0).to_numpy() >> (WIDTH * exact)) // patterns_per_start
        edges = np.concatenate(([0], cuts, [whole.num_rows]))
        sizes, first = np.diff(edges), edges[:-1]
        pairs = first[sizes == 2]
        pairs = pairs[linked(fps[pairs] ^ fps[pairs + 1], starts[pairs])]
        found = list(zip(fps[pairs].tolist(), fps[pairs + 1].tolist()))
        for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found += spanning_links(fps[a : a + n], int(starts[a]))
        if found:
            both = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def links(fps: DataFrame, exact: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect just the fingerprints that chains of links of BUDGET bits connect.

    ``fps`` has one column fp of distinct values. Of each group that shares a key, the links of a spanning forest are
    returned, never all pairs. A group over ``block`` values is compared block against block, which is exact too.
    """
    exact = exact or (3 if fps.count() <= 1 << 24 else 4)
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), exact)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes.hint("shuffle_hash"), "key")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    others = F.when(n_blocks > 1, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j"))))
    dealt = shared.select("fp", "key", F.explode(F.coalesce(others, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).alias("p"))
    units = dealt.select("key", "p.i", "p.j", "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return units.mapInArrow(_compare(len(chains(exact)) // SEGMENTS, exact), "a long, b long")


def classes(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``marked`` (key, fp): root is the smallest fp of its component."""
    least = cut(marked.groupBy("fp").agg(F.min(F.col(f"`{key}`").cast("long")).alias("least")))
    found = components(links(least.select("fp")))
    grouped = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that no aggregate shares the stage of the join: Spark can then split a root that very many have.
    names = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    return grouped.select("fp", "root").join(names, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component_id) of each row of ``df``.

    The fingerprint has 16 hex digits; component_id is the smallest key that links of at most 4 bits reach, itself
    included. A-Z are lower-cased; words are runs of bytes other than ASCII white space; a text of fewer than four words
    is one shingle; one of none (null too) has fingerprint zero and links like any other. Null keys name no component
    (component_id is null where all keys are). Repeated rows and ties share a component; an empty table gives no rows.
    """
    marked = cut(with_fingerprints(df.select(F.col(f"`{key}`"), F.col(f"`{text_col}`").alias("__t")), "__t", shingle).drop("__t"))
    out = marked.join(classes(marked, key).drop("root"), "fp", "left")
    return out.select(F.col(f"`{key}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest key of each component, whole; a repeated key once. Columns as in ``df``.

    Of a component whose keys are all null one row stays.
    """
    marked = cut(with_fingerprints(df.select(F.col(f"`{key}`"), F.col(f"`{text_col}`").alias("__t")), "__t").drop("__t"))
    found = cut(classes(marked, key))
    kept = found.filter("component_id IS NOT NULL").select(F.col("component_id").alias("__kept")).distinct()
    out = df.join(kept, F.col(f"`{key}`").cast("long") == F.col("__kept"), "left_semi")
    n, named, distinct = marked.agg(F.count(F.lit(1)), F.count(F.col(f"`{key}`")), F.countDistinct(F.col(f"`{key}`"))).first()
    if distinct < named:
        out = out.dropDuplicates([key])
    if named < n:
        nameless = with_fingerprints(df.filter(F.col(f"`{key}`").isNull()), text_col).join(found.filter("component_id IS NULL"), "fp").dropDuplicates(["root"])
        out = out.unionByName(nameless.select(*(F.col(f"`{c}`") for c in df.columns)))
    return out
