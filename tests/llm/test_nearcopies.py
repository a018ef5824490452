"""Near copies of the pipeline against all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from propago.llm import nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def bag(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_of(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [(i, bag(t)) for i, t in rows]
    for i, a in bags:
        for j, b in bags:
            if j < i and (not a and not b or a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in root})


def test_stage_drops_near_copies(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    line = [word() for _ in range(30)]
    texts = [None, "", " \n", "two words", "Two  words", "one"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 300))]
        for edits in (0, 0, 1, 2, 3, 5, 7, 9):
            copy = list(base)
            for k in r.sample(range(len(base)), edits):
                copy[k] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base + line))
    texts += [" ".join(line + [word() for _ in range(40)]) for _ in range(40)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    want = kept_of(rows)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(x.doc_id for x in got.collect()) == want and got.columns == df.columns
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "c d"), (None, "c d")], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.text) for x in nearcopies.representatives(odd).collect()) == [(-1, "c d"), (1, "a b")]
    assert nearcopies.representatives(odd.filter("false")).count() == 0


def test_groups_within_tasks_lose_no_link(spark):
    r = random.Random(5)
    base = [r.sample(range(1000), 40) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(12):
            gone = set(r.sample(b, r.randint(0, 8)))
            sets.append(np.array(sorted((set(b) - gone) | {r.randint(1000, 9000) for _ in range(len(gone) // 3)}), np.int64))
    n = len(sets)

    def roots(links):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in links:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in range(n)]

    near = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    want = [(i, j) for j in range(n) for i in range(j) if near(i, j)]
    found = nearcopies.near_links(np.arange(n), np.zeros(n, int), np.arange(n), sets)
    assert roots(found) == roots(want) and all(near(*x) for x in found) and len(found) < n
    half = np.arange(n) % 2
    across = nearcopies.near_links(np.arange(n), half, np.arange(n), sets)
    assert roots(across) == roots([x for x in want if half[x[0]] != half[x[1]]])
    assert nearcopies.near_links(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), []) == []


def test_frequent_shingles_in_blocks(spark):
    r = random.Random(6)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for k in r.sample(range(80), r.randint(0, 4)):
            copy[k] = f"x{r.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    raw = df.selectExpr("text AS __t")
    nodes = nearcopies._marked(df.selectExpr("doc_id AS __key", "text AS __t"), np.zeros(0, np.uint64)).groupBy("node").agg(F.max("n").alias("n"), F.first("prefix").alias("prefix"))
    root = {x.node: x.root for x in nearcopies.components(nearcopies.links(nodes, raw, small=2, block=8)).collect()}
    node = [nearcopies.node_of(nearcopies.shingles(t.encode())) for t in texts]
    groups = {}
    for i, k in enumerate(node):
        groups.setdefault(root.get(k, k), set()).add(i)
    assert sorted(min(g) for g in groups.values()) == kept_of(list(enumerate(texts)))


def test_sketches_reject_no_near_copy(spark):
    r = random.Random(7)
    draw = lambda n: {r.getrandbits(63) for _ in range(n)}
    pairs = [(set(), set())]
    for n in (1, 5, 60, 64, 65, 130, 1000, 4100):
        base = draw(n)
        for share in (0, 0.05, 0.1, 0.11, 0.2, 0.5, 1):
            gone = set(r.sample(sorted(base), int(n * share)))
            pairs += [(base, base - gone), (base, (base - gone) | draw(len(gone))), (base, base | draw(int(n * share / 4)))]
    near = [not a and not b or 5 * len(a & b) >= 4 * len(a | b) for a, b in pairs]
    close = [5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) for a, b in pairs]
    pairs = [p for p, c in zip(pairs, close) if c]
    near = [x for x, c in zip(near, close) if c]
    rows = []
    for k, sides in enumerate(pairs):
        for at, s in enumerate(sides):
            rows.append((2 * k + at, len(s), nearcopies.sketch(np.array(sorted(s), np.uint64)).tolist()))
    nodes = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    asked = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs))], "a long, b long")
    left = {x.a // 2 for x in nearcopies._possible(asked, nodes).collect()}
    assert {k for k, x in enumerate(near) if x} <= left
    assert not {k for k, (a, b) in enumerate(pairs) if len(a & b) < 0.55 * len(a) and len(a) >= 60} & left
    assert nearcopies._possible(asked, nodes.drop("sketch")).count() == len(pairs)


def test_sketches_leave_every_near_copy_open():
    r = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 63, r.integers(5, 400), np.int64).astype(np.uint64)
        for _ in range(3):
            kept = base[r.random(len(base)) > r.choice([0.0, 0.05, 0.15, 0.4])]
            sets.append(np.unique(np.concatenate([kept, r.integers(0, 1 << 63, r.integers(0, 8), np.int64).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    n, roots, sides = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2, np.arange(len(sets)) % 2
    near = lambda a, b: 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
    for side in (sides, np.zeros(len(sets), int)):
        found = nearcopies.open_nodes(n, roots, side, [nearcopies.sketch(s) for s in sets])
        two = len(set(side.tolist())) > 1
        want = [any(near(a, b) and roots[i] != roots[j] and (not two or side[i] != side[j]) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
        assert all(f or not w for f, w in zip(found, want)) and found.sum() < len(sets) and sum(want) > 20


def test_blocks_of_a_group_bring_few_sets_together(spark):
    """Texts that share a passage and little else: sketches settle a group of several blocks, and no set is read for it."""
    r = random.Random(5)
    shared = " ".join(f"s{k}" for k in range(30))
    texts = [shared + " " + " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60)) for _ in range(120)]
    texts += [texts[3] + " more words", "before " + texts[77]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marked = nearcopies._marked(df.select(F.col("text").alias("__t"), "doc_id"), np.zeros(0, np.uint64))
    nodes = marked.select("node", "n", "prefix", "sketch", "doc_id")
    ids = {x.node: x.doc_id for x in nodes.collect()}
    out = nearcopies.links(nodes.drop("doc_id"), df.select(F.col("text").alias("__t")), small=4, block=16).collect()
    assert {tuple(sorted((ids[x.a], ids[x.b]))) for x in out} == {(3, 120), (77, 121)}


def test_near_copies_are_of_simhashes_too_and_chains_pass_through_both(spark):
    """Repeats decide a SimHash but not a set of shingles: 0 and 1 have one fingerprint, 1 and 2 nearly one set of shingles."""
    tail = lambda x: " ".join(f"{x}{k}" for k in range(20))
    loop = "one two three four five " * 100
    far = "one two three four five " * 2 + tail("y")
    texts = [loop + tail("x"), loop + tail("y"), far, tail("z")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    fps = [simhash.fingerprint_bits(t.encode()) for t in texts]
    sets = [set(nearcopies.shingles(t.encode()).tolist()) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert (fps[0] ^ fps[1]).bit_count() <= 4 < min((fps[2] ^ fps[k]).bit_count() for k in (0, 1, 3))
    assert like(0, 1) < 0.8 <= like(1, 2) and like(0, 2) < 0.8
    assert sorted(r.doc_id for r in nearcopies.representatives(df).collect()) == [0, 3]
