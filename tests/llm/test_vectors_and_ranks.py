"""Ranked search, centroids and nearest neighbours against plain versions; clashing columns of every operator."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from propago.llm import centroids, decontaminate, lexical, multiindex, nearcopies, sharding, substrings, toxicity, warc
from propago.llm.queries import QUERIES

TERM = re.compile(lexical.TERM)
SF = "/root/testdata/sf0.001"


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    """The contract, in plain integers."""
    tf = [(i, Counter(terms_of(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, length = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    united = {}
    for item, text in items:
        united.setdefault(item, set()).update(terms_of(text))
    for item, words in united.items():
        scores = []
        for place, (i, c) in enumerate(tf):
            m = 100 - 50 + (50 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, place))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search_by_brute_force(spark, monkeypatch, small):
    if small:  # many shards, many blocks of items, texts in pieces
        monkeypatch.setattr(lexical, "SHARD_BYTES", 200)
        monkeypatch.setattr(lexical, "SHARD_DOCS", 4)
        monkeypatch.setattr(lexical, "BLOCK_BYTES", 100)
        monkeypatch.setattr(lexical, "PIECE", 7)
    r = random.Random(4)
    word = lambda: r.choice(["ab", "Ab", "b1", "ÉT", "ét", "日本", "c", "dd", "e" * 12])
    text = lambda n: "".join(word() + r.choice([" ", ", ", "--", "\n\t", "[x]"]) for _ in range(n))
    docs = [(k, text(r.choice([0, 1, 5, 20]))) for k in range(40)] + [(100, None), (101, ""), (102, "ab"), (103, "ab"), (103, "ab"), (None, "ab b1"), (104, "!? .")]
    items = [(k, text(r.choice([1, 3, 8]))) for k in range(9)] + [(50, None), (51, "zzz"), (52, "ab"), (52, "b1 b1"), (53, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, id long, terms string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")
    for k in (6, 60):
        got = sorted((tuple(x) for x in lexical.search(lexical.build(df), bench, k).collect()), key=repr)
        assert got == brute_search(docs, items, k)
    assert any(doc is None for _, _, doc, _ in got)
    nothing = lexical.build(df.filter("false"))
    assert lexical.search(nothing, bench).count() == 0 and lexical.search(lexical.build(df), bench.filter("false")).count() == 0


def test_best_keeps_ties_by_id():
    scores, ids = np.array([5, 7, 5, 5, 1, 5]), np.array([9, 1, 4, 8, 0, 3])
    assert sorted(ids[lexical.best(scores, ids, 3)]) == [1, 3, 4] and len(lexical.best(scores, ids, 9)) == 6


def brute_centroids(rows, k, rounds):
    kept = [(i, np.array([math.floor(1024 * float(x)) for x in v], object)) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    c = [x for _, _, x in sorted(((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), list(x), x) for i, x in kept), key=lambda y: y[:2])[:k]]
    near = lambda x: min((int(((x - y) ** 2).sum()), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        c = [np.array([sum(x[d] for (_, x), j in zip(kept, own) if j == n) // own.count(n) for d in range(3)], object) if n in own else y for n, y in enumerate(c)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], [[int(v) for v in y] for y in c]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_centroids_by_brute_force(spark, k):
    r = random.Random(k)
    at = [(0, 0, 0), (1, 1, 0), (-1, 0.5, 2)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in at[i % 3]]) for i in range(60)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(60, 70)] + [(69, [0.5, 0.5, 0.5]), (None, [0.1, 0.1, 0.1])]
    rows += [(80, None), (81, [1.0, 2.0]), (82, [1.0, None, 2.0]), (83, [1.0, float("nan"), 2.0]), (84, [1.0, float("inf"), 2.0]), (85, [])]
    df = spark.createDataFrame([(i, v, 7, 7.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, upper double")
    found = centroids.cluster(df, k, 6, dims=3)
    want, final = brute_centroids(rows, k, 6)
    assert sorted((tuple(x) for x in found.rows.collect()), key=repr) == sorted(want, key=repr) and found.centroids == final
    out = centroids.report(found).collect()
    total = sum(d for _, _, d in want)
    assert all(x.inertia == total and x.centroid_sha256 == centroids.digest(final[x.cluster]) and x.cluster_inertia == sum(d for _, j, d in want if j == x.cluster) for x in out)
    if k == 5:  # bounds spare most full scans once the centroids settle
        assert found.scans[0] > 30 and found.scans[-1] < len(want) / 2
    assert centroids.cluster(df.filter("false"), k, 2, dims=3).rows.count() == 0
    with pytest.raises(Exception, match="is not under"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id long, embedding array<double>"), 1, 1, 3)


def test_hamerly_bounds_never_keep_a_wrong_centroid():
    r = np.random.default_rng(0)
    x, c = r.integers(-3000, 3000, (400, 5)), r.integers(-3000, 3000, (6, 5))
    c[3] = c[1]  # ties go to the smaller number
    state, drift = None, np.zeros(6)
    for step in range(8):
        cluster, upper, lower, _ = centroids.reassign(x, state, c, drift)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all()
        two = np.sort(np.sqrt(every), axis=1)
        assert (upper >= two[:, 0] - 1e-6).all() and (lower <= two[:, 1] + 1e-6).all()
        state, old = (cluster, upper, lower), c
        c = c + r.integers(-40, 40, c.shape) // (step + 1)
        drift = np.sqrt(((c - old) ** 2).sum(axis=1).astype(float)) * (1 + centroids.SLACK)


def brute_neighbours(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q in queries:
            near = sorted((-float(multiindex.cosine(v[None], w[None])[0]), i) for i, w in usable if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours_are_exact_over_all_cells_and_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "HALF", 4)
    monkeypatch.setattr(multiindex, "SHARD", 8)
    monkeypatch.setattr(multiindex, "BLOCK", 5)
    monkeypatch.setattr(multiindex, "ASKED", 3)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 130)] + [(200, [1e200, 0.0, 1e190, 0.0]), (201, [1e-200, 0.0, 0.0, 0.0])]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [1.0]), (305, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, shard int, cell int")
    index = multiindex.build(df)
    assert int(index.counts.sum()) == 92 and index.books.dims == 4
    asked = [0, 7, 100, 129, 200, 201, 300, 301]
    got = {}
    for x in multiindex.search(index, df.filter(F.col("vec_id").isin(asked)), 5, share=1.0).orderBy("query", "rank").collect():
        got.setdefault(x["query"], []).append((x["id"], x["score"]))
    assert got == brute_neighbours(rows, asked, 5) and [i for i, _ in got[129]] == [100, 101, 102, 103, 104]
    few = df.filter("vec_id < 3")
    assert multiindex.search(multiindex.build(few), few, 5).count() == 6
    assert multiindex.search(multiindex.build(df.filter("false")), df, 5).count() == 0


def test_cells_come_in_order_of_distance():
    r = np.random.default_rng(3)
    near, far, counts = r.uniform(size=6), r.uniform(size=5), r.integers(0, 3, 30)
    out = multiindex.traverse(near, far, counts, 10**9)
    both = (near[:, None] + far[None, :]).ravel()
    assert out == [c for c in np.argsort(both, kind="stable").tolist() if counts[c]]
    some = multiindex.traverse(near, far, counts, 9)
    assert some == out[: len(some)] and counts[some].sum() >= 9 > counts[some[:-1]].sum()


def test_recall_of_the_query(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        rows = QUERIES["op13_multiindex"](spark, sf).collect()
        table = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow()
        x, ids = np.array(table["embedding"].to_pylist(), float), table["vec_id"].to_numpy()
        hits = 0
        for q in ids[ids % 50 == 0]:
            s = (x @ x[ids == q][0]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[ids == q][0])
            s[ids == q] = -9
            best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
            mine = [r for r in rows if r.query_id == q]
            assert sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5] and all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in mine)
            hits += len(best & {r.vec_id for r in mine})
        assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


NAMES = "n_words n_hit longest items spans __hits __bytes __spans __new __cover __row row __text __gone __kept __key own __t node n prefix sketch __block __hex __size hex depth same shard_id bucket"


def test_clashing_columns_pass_through(spark):
    names = NAMES.split()
    texts = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen"] * 2 + ["a short text", None, ""]
    kinds = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    df = spark.createDataFrame([(i, t, len(t or ""), *(f"{c}{i}" for c in names)) for i, t in enumerate(texts)], kinds)
    same = lambda out, dropped=(): all(r[c] == f"{c}{r.doc_id}" for r in out for c in names if c not in dropped)
    kept = nearcopies.representatives(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3} and same(kept.collect())
    cut = substrings.remove_repeats(df)
    assert {r.doc_id: r.n_removed for r in cut.collect()} == {0: 0, 1: 14, 2: 0, 3: 0, 4: 0} and same(cut.collect(), ("n_words",))
    dealt = sharding.shard(df, 100)
    assert dealt.count() == 5 and same(dealt.collect(), ("shard_id",))
    bench = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {2, 3, 4} and same(clean.collect())
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    passed = toxicity.drop_toxic(df, labels)
    assert passed.columns == df.columns and same(passed.collect()) and passed.count() == 5


def test_salvage_is_linear_in_damaged_members():
    import time

    def archive(n):
        return b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 4\r\n\r\nb%03d\r\n\r\n" % (i % 1000)) for i in range(n))

    def took(n):
        start = time.perf_counter()
        assert [set(x) for x in warc.salvage(archive(n))] == [{"start", "end", "error"}]
        return time.perf_counter() - start

    took(100)
    assert took(16_000) < 40 * max(took(1_000), 0.02)


def test_negation_and_reports_have_a_reach():
    rules = toxicity.grammar()
    of = lambda t: {k: n for k, n in zip(toxicity.KINDS, toxicity.matched_clauses(t, rules)) if n}
    for text in ("I do not know why but you are an idiot", "no you idiot", "he is never late you moron", "She told me to stop, you idiot", "she said hello and you are an idiot"):
        assert of(text) == {"insult at target": 1}, text
    for text in ("he said that you are stupid", "she said to me: you are an idiot", "he said you are an idiot"):
        assert of(text) == {"insult reported": 1}, text
    assert of("you are not an idiot") == {"insult negated": 1}
    assert of("you idiot. " * 40) == {"insult at target": 40}  # no count is capped
    some = [[0] * len(toxicity.KINDS), [4 if k == "insult" else 0 for k in toxicity.KINDS]]
    assert toxicity._design(some)[1, 1:3].tolist() == [1.0, 2.0] and toxicity._design(some)[0].sum() == 1


def test_sample_of_the_index_is_not_sent_by_every_task(spark, monkeypatch):
    """The tasks together send few rows more than the sample has, and it is the same: the rows of smallest hash."""
    monkeypatch.setattr(multiindex, "SAMPLE", 100)
    rows = spark.range(20_000).selectExpr("id", "array(sin(id), cos(id), sin(id * 3)) AS v").repartition(8)
    hashed = rows.select("v", F.xxhash64("v", "id").alias("h"))
    lowest = multiindex._lowest(rows)
    assert 100 <= lowest.count() < 150
    assert lowest.orderBy("h", "v").limit(100).collect() == hashed.orderBy("h", "v").limit(100).collect()
    assert multiindex._lowest(rows.limit(30)).count() == 30 and multiindex._lowest(rows.filter("false")).count() == 0
