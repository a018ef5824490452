"""Near copies of the pipeline: SimHash by the pigeonring filter, completed by exact Jaccard similarity of five-word shingles, found by a prefix filter that loses none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from propago.llm import simhash
from propago.llm.arrow import append_columns, list_of
from propago.llm.components import components
from propago.session import cut, written

SHINGLE = 5
#: Near copies share at least 4/5 of the distinct shingles of both.
NUM, DEN = 4, 5
SEED = 42
#: Shingles that go last in a document's order: common in a sample of about SAMPLE documents. Any choice is exact; a good one is fast.
SAMPLE, COMMON_TIMES, COMMON_MOST = 20_000, 8, 100_000
#: Nodes that have a shingle at most for their pairs to be rows.
SMALL = 16
#: Nodes of a group that a task compares at once.
BLOCK = 1_024
#: Bits of the map of the nodes whose shingles are read again, a superset of them; its size does not depend on the corpus.
MAP_BITS = 24
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: bytes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted. A text of fewer words is one shingle, of none has none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, n)
    k = min(n, SHINGLE)
    x = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        x = x * _ODD + h[j : n - k + 1 + j]
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return np.unique(x ^ (x >> np.uint64(29)))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles: texts of equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)).astype(np.int64))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the global order (common ones last, then by hash) that two near copies cannot all differ in."""
    n = len(found)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        last = common[at] == found
        found = np.concatenate((found[~last], found[last]))
    return found[: n - -(-n * NUM // DEN) + 1] if n else found


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by their low bits, as 64-bit words: a power of two of bits, from 64, not fewer than shingles.

    Sketches of two sets, folded to one width, differ in at most as many bits as the sets differ in shingles.
    """
    bits = max(64, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def common_shingles(texts: DataFrame, n_rows: int) -> np.ndarray:
    """Shingles that many distinct sampled texts have (column __t)."""
    share = min(1.0, SAMPLE / max(n_rows, 1))
    drawn = texts.filter(F.pmod(F.xxhash64("__t"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["__t"])

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["s"])

    counted = drawn.select(F.col("__t").cast("binary")).filter("__t IS NOT NULL").mapInArrow(run, "s long").groupBy("s").count()
    found = counted.filter(F.col("count") >= COMMON_TIMES).orderBy(F.desc("count"), "s").limit(COMMON_MOST).select("s").collect()
    return np.sort(np.array([r.s for r in found], np.int64).view(np.uint64))


def _marked(df: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """Append node, n (distinct shingles) and sketch, and prefix if ``common`` is given, to rows with a column __t."""
    held = df.sparkSession.sparkContext.broadcast(common) if common is not None else None

    def make():
        def fn(texts):
            sets = [shingles(t or b"") for t in texts]
            out = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), list_of([sketch(s) for s in sets], pa.int64())]
            return (*out, list_of([prefix(s, held.value).view(np.int64) for s in sets], pa.int64())) if held else tuple(out)

        return fn

    lists = ("sketch", "prefix") if held else ("sketch",)
    fields = [StructField("node", LongType()), StructField("n", LongType()), *(StructField(x, ArrayType(LongType())) for x in lists)]
    return append_columns(df.withColumn("__bytes", F.col("__t").cast("string")), {"__bytes": "binary"}, fields, make).drop("__bytes")


def _tokens(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(token, node, n): the shingles of each node's prefix, once a task that has the node, straight from the texts (__t)."""
    held = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        told = set()  # of the nodes of one task's share of the texts
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                tokens, nodes, sizes = [], [], []
                for t in batch.slice(at, 256).column(0).to_pylist():
                    found = shingles(t or b"")
                    if (node := node_of(found)) not in told:
                        told.add(node)
                        tokens.append(prefix(found, held.value).view(np.int64))
                        nodes.append(node)
                        sizes.append(len(found))
                each = [len(x) for x in tokens]
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
                arrays = [pa.array(flat), *(pa.array(np.repeat(np.array(x, np.int64), each)) for x in (nodes, sizes))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "n"])

    return texts.select(F.col("__t").cast("string").cast("binary")).mapInArrow(run, "token long, node long, n long")


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, and of few others: a bounded map of bits goes to the tasks, not the nodes."""
    slot = F.col("node").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = wanted.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, CAST((node & {(1 << MAP_BITS) - 1}) & 63 AS INT))").alias("b"))
    packed = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        packed[r.w] = r.b
    held = texts.sparkSession.sparkContext.broadcast(packed.view(np.uint64))

    def run(batches):
        told = set()  # a task gives a node once, so that large groups of copies send few rows
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                nodes, sets = [], []
                for t in batch.slice(at, 256).column(0).to_pylist():
                    found = shingles(t or b"")
                    node = node_of(found)
                    low = node & ((1 << MAP_BITS) - 1)
                    if (int(held.value[low >> 6]) >> (low & 63)) & 1 and node not in told:
                        told.add(node)
                        nodes.append(node)
                        sets.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), list_of(sets, pa.int64())], names=["node", "shingles"])

    return texts.select(F.col("__t").cast("string").cast("binary")).mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b), of close sizes, without those that their sketches prove not to be near copies; all, if there are no sketches.

    Near copies of x and y shingles differ in at most (x + y) / 9 of them. Their sketches are of one width, or one is
    twice as wide as the other.
    """
    if "sketch" not in nodes.columns:
        return pairs
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    width = F.least(F.size("sa"), F.size("sb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    sa, sb = (F.when(F.size(x) > width, F.zip_with(F.slice(x, 1, width), F.slice(x, width + 1, width), xor)).otherwise(F.col(x)) for x in ("sa", "sb"))
    differ = F.aggregate(F.zip_with(sa, sb, xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    return pairs.join(one, "a").join(two, "b").filter((DEN + NUM) * differ <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of NUM / DEN or more, by their whole sets of shingles."""
    sets = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return cut(pairs.join(one, "a").join(two, "b").filter((DEN + NUM) * both >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b"))


def near_links(a: np.ndarray, sides: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between nodes of different roots that connect all that near copies among them connect, never all pairs.

    Nodes ``a`` with their shingles; where there are two ``sides``, only nodes of different sides are compared. A
    node's overlaps with all others come from the lists of nodes by shingle at once.
    """
    sizes = np.array([len(x) for x in sets], int)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, often = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    listed = owner[np.argsort(code, kind="stable")]  # nodes by shingle
    first = np.concatenate(([0], np.cumsum(often)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    both = len(np.unique(sides)) > 1
    group, out = np.unique(roots, return_inverse=True)[1], []
    for k in range(len(sets)):
        if (group == group[k]).all():
            continue
        mine = code[at[k] : at[k + 1]]
        mine = mine[often[mine] > 1]
        lengths = often[mine]
        starts = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        overlap = np.bincount(listed[starts + np.arange(len(starts))], minlength=len(sets))
        near = ((DEN + NUM) * overlap >= NUM * (sizes + sizes[k])) & (overlap > 0) & (group != group[k])
        if both:
            near &= sides != sides[k]
        for j in np.flatnonzero(near).tolist():
            if group[j] != group[k]:
                out.append((int(a[k]), int(a[j])))
                group[group == group[j]] = group[k]
    return out


def _compare(table: pa.Table) -> pa.Table:
    sets = [x.values.to_numpy() for x in table.column("shingles")]
    found = near_links(*(table.column(c).to_numpy() for c in ("node", "mine", "root")), sets)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def open_nodes(n: np.ndarray, roots: np.ndarray, sides: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Which nodes have another one of a different root, and of another side where there are two, that their sketches and
    sizes do not prove to be no near copy of theirs; see ``_possible``."""
    n, widths = n.astype(np.int64), np.array([len(s) for s in sketches], int)
    places = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    words = {w: np.stack([sketches[k] for k in own]).view(np.uint64) for w, own in places.items()}
    both, out = len(np.unique(sides)) > 1, np.zeros(len(n), bool)
    for w, own in places.items():
        for wider in (w, 2 * w):
            if wider not in places:
                continue
            others, held = places[wider], words[wider] if wider == w else words[wider][:, :w] ^ words[wider][:, w:]
            for row, k in zip(words[w], own):
                near = (DEN * np.minimum(n[others], n[k]) >= NUM * np.maximum(n[others], n[k])) & (roots[others] != roots[k])
                if both:
                    near &= sides[others] != sides[k]
                at = np.flatnonzero(near)
                differ = np.bitwise_count(held[at] ^ row).sum(axis=1, dtype=np.int64)
                hit = at[(DEN + NUM) * differ <= (DEN - NUM) * (n[others[at]] + n[k])]
                if len(hit):
                    out[k] = True
                    out[others[hit]] = True
    return out


_UNIT = ["key", "i", "j", "mine", "node", "root"]


def _open(table: pa.Table) -> pa.Table:
    sketches = [x.values.to_numpy() for x in table.column("sketch")]
    return table.select(_UNIT).filter(pa.array(open_nodes(*(table.column(c).to_numpy() for c in ("n", "root", "mine")), sketches)))


def links(nodes: DataFrame, texts: DataFrame, small: int = SMALL, block: int = BLOCK, tokens: DataFrame | None = None) -> DataFrame:
    """Pairs of near copies that connect all that near copies connect. ``nodes`` has node and n, one row a node, may have sketch, and has prefix
    where ``tokens`` (token, node, n; rows may repeat) are not given.

    Near copies share a shingle of their prefixes. First each node is compared with the smallest one of each of its
    shingles, in time linear in them. What is not connected then: nodes of a shingle that ``small`` nodes have at most are
    paired, so a node has few pairs for each; those of a more frequent shingle both belong to the group of its smallest
    node, and such groups are compared within tasks, which return the links of a spanning forest; groups over ``block``
    nodes are compared block by block, a node going to as many pairs of blocks as its group has blocks. Blocks are first
    compared by sketches, a sixty-fourth of the sets' size; only nodes that these leave open have their sets of shingles
    brought together, and so it is with pairs.
    """
    token = tokens if tokens is not None else nodes.select("node", "n", F.explode("prefix").alias("token"))
    # Rows may count a node more than once; they only choose between two ways that are both exact.
    sizes = token.groupBy("token").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("rows")).filter("least.node <> most")
    named = token.join(sizes.hint("shuffle_hash"), "token").dropDuplicates(["token", "node"])  # dealt by token already
    shared = written(named.select("token", "node", "n", F.col("least.node").alias("key"), F.col("least.n").alias("key_n"), "rows"))
    close = lambda x, y: (DEN * F.least(x, y) >= NUM * F.greatest(x, y))
    star = shared.filter((F.col("node") != F.col("key")) & close(F.col("n"), F.col("key_n"))).select(F.col("key").alias("a"), F.col("node").alias("b")).distinct()
    star = cut(_possible(star, nodes))
    first = _verified(texts, star)
    roots = components(first)

    few = shared.filter(F.col("rows") <= small).select("token", "node", "n").join(roots, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
    open_tokens = few.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    few = cut(few.join(open_tokens, "token"))
    x, y = few.alias("x"), few.alias("y")
    paired = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & close(F.col("x.n"), F.col("y.n")))
    paired = _possible(paired.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), nodes)
    paired = cut(paired.join(star, ["a", "b"], "left_anti"))

    member = shared.filter(F.col("rows") > small).select("key", "node").distinct()
    named = cut(member.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    open_groups = cut(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi").select("key", "rows"))
    named = cut(named.join(open_groups, "key"))
    blocks = F.ceil(F.col("rows") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    units = lambda rows, *more: rows.select("key", "node", "root", mine.alias("mine"), *more, F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "mine", "node", "root", *more)
    if "sketch" in nodes.columns:
        slim = units(named.join(nodes.select("node", "n", "sketch"), "node"), "n", "sketch")
        still = cut(slim.groupBy("key", "i", "j").applyInArrow(_open, "key long, i int, j int, mine int, node long, root long"))
        ready = still.join(_sets(texts, still.select("node")), "node")
    else:
        ready = units(named.join(_sets(texts, named.select("node")), "node"), "shingles")
    grouped = cut(ready.groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long").distinct())
    return first.unionByName(_verified(texts, paired)).unionByName(grouped)


def simhash_links(marked: DataFrame) -> DataFrame:
    """(a, b): links from the smallest node of each component of fingerprints to its others. ``marked`` has node and fp."""
    each = cut(marked.select("node", "fp").distinct())
    found = components(simhash.links(cut(each.select("fp").distinct())))
    named = cut(each.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.col("node").alias("b"), F.coalesce("root", "fp").alias("root")))
    return named.join(cut(named.groupBy("root").agg(F.min("b").alias("a"))), "root").filter("a <> b").select("a", "b")


def representatives(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest key of each component of near copies, whole; a repeated key once. Columns as in ``df``.

    Near copies have SimHash fingerprints that differ in at most 4 bits (see ``simhash``), or a Jaccard similarity of at least 0.8 of their sets of five-word shingles (words of lower-cased
    bytes other than ASCII white space); texts without words are near copies of each other. Of a component whose keys
    are all null one row stays. Shingles are compared as 64-bit hashes.
    """
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("__t"))
    common = common_shingles(texts, df.count())
    keyed = df.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text_col}`").cast("string").alias("__t"))
    marked = cut(_marked(simhash.with_fingerprints(keyed, "__t")).drop("__t"))
    nodes = cut(marked.groupBy("node").agg(F.min("__key").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    found = components(simhash_links(marked).unionByName(links(nodes, texts, tokens=_tokens(texts, common))))
    grouped = nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = cut(grouped.groupBy("root").agg(F.min("least").alias("__kept")))
    # Few keys go: as a table of a known size they are shipped to the texts where they are small, and joined where not.
    gone = written(marked.filter("__key IS NOT NULL").select(F.col("__key").alias("__gone")).distinct().join(names, F.col("__gone") == F.col("__kept"), "left_anti"))
    # Rows go as structs, so that no column of theirs can clash.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("own")).filter("own IS NOT NULL")
    out = rows.join(gone, F.col("own") == F.col("__gone"), "left_anti").select("row.*")
    n, named, distinct = marked.agg(F.count(F.lit(1)), F.count("__key"), F.countDistinct("__key")).first()
    if distinct < named:
        out = out.dropDuplicates([key])
    if named < n:
        bare = grouped.join(names.filter("__kept IS NULL"), "root").select("node", "root")
        row = df.filter(F.col(f"`{key}`").isNull()).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__t"))
        out = out.unionByName(_marked(row).join(bare, "node").dropDuplicates(["root"]).select("__row.*"))
    return out
