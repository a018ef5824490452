"""Each corpus operator on small fixtures against plain Python, with nulls, empties, ties, repeats and clashing names."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from propago.llm import bpe, decontaminate, fingerprints, langid, pii, sharding, simhash, substrings, toxicity, trees, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def prose(seed, n, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)) if words else ""


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1. substring dedup


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = {k + j for k in range(len(w) - window + 1) if min(first[tuple(w[k : k + window])]) < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_brute_force(spark):
    shared = prose(1, 20)
    texts = [prose(2, 30) + " " + shared, shared + "\t" + prose(3, 5), None, "", "a b", prose(2, 30) + " " + shared, "x " * 40, "x " * 20, shared + " " + shared]
    rows = list(enumerate(texts))
    want = brute_repeats(rows, 13)
    for block in (2, 512):
        df = docs(spark, texts).withColumn("kept_text", F.lit("old"))
        got = substrings.remove_repeats(df, block_docs=block, bucket_windows=20)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == want
        assert got.columns.count("kept_text") == 1
    spans = {r.doc_id: [(x.start, x.stop) for x in r.removed] for r in got.collect()}
    assert spans[1] == [(0, 20)]


def test_substrings_repeated_and_null_keys(spark):
    t = prose(4, 20)
    got = substrings.remove_repeats(docs(spark, [t, t, t, t], [5, 5, None, None]))
    assert sorted((r.doc_id is None, r.n_removed) for r in got.collect()) == [(False, 0), (False, 0), (True, 20), (True, 20)]
    assert substrings.remove_repeats(docs(spark, []), window=3).count() == 0


def test_substrings_of_a_key_with_many_rows(spark):
    t = [prose(k, 16) for k in range(6)]
    texts, ids = [t[0], t[1]] + [t[1], t[2], t[3]] * 10 + [t[3], t[4], t[0]], [1, 2] + [5] * 30 + [6, 7, 8]
    got = substrings.remove_repeats(docs(spark, texts, ids), block_docs=4)
    want = sorted([(1, 0), (2, 0), *([(5, 16)] * 10), *([(5, 0)] * 20), (6, 16), (7, 0), (8, 16)])
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == want
    nulls = substrings.remove_repeats(docs(spark, texts, [None if i == 5 else i for i in ids]), block_docs=4)
    assert sorted((r.doc_id or 99, r.n_removed) for r in nulls.collect()) == sorted([(1, 0), (2, 0), (6, 0), (7, 0), (8, 16), *([(99, 16)] * 20), *([(99, 0)] * 10)])


# 2. BPE


def test_bpe_round_trip(spark):
    texts = [None, "", "Hello  world\n\n x1y2²5 it's 你好 😀 <|endoftext|>", " " * 50 + "a", "z" * 5000, "ab1 " * 3000, "a\x1c\x1d!b " * 200]
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts).withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bpe.encode_text(enc, t or "", 64).tolist() == ids


def test_bpe_decodes_bytes_that_are_no_text(spark):
    one = spark.createDataFrame([([0, 1, 200],), (None,)], "ids array<int>")
    got = [bytes(r.decoded) for r in bpe.decode(one, RANKS, public_tokenizers.PATTERN).collect()]
    assert len(got[0]) >= 3 and got[1] == b""


# 3. WARC


def test_warc_writes_and_reads(spark, tmp_path):
    rows = [(1, "u1", "<p>ä</p>"), (2, "ü2", "<p>ä</p>"), (3, None, None), (4, "u", ""), (5, "u", "once"), (5, "u", "twin"), (None, "u", "once")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert all(r.error is None for r in got)
    assert sorted((r.id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [(0, "revisit", 5, 4), (1, "revisit", 2, 9), (2, "response", 0, 9), (3, "revisit", 4, 0), (4, "response", 0, 0), (5, "response", 0, 4), (5, "response", 0, 4)]
    assert {r.payload_digest for r in got if r.id in (1, 2)} == {base64.b32encode(hashlib.sha1("<p>ä</p>".encode()).digest()).decode()}
    warc.write(df.filter("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_salvage():
    records = [warc._record("response", k, "u", warc.digest32(p), len(p), warc._response(p)) for k, p in enumerate([b"one", b"two", b"three", b"four"])]
    plain = b"".join(records)
    at = [sum(map(len, records[:k])) for k in range(5)]
    assert [x["record"]["payload"] for x in warc.salvage(plain)] == [b"one", b"two", b"three", b"four"]
    broken = bytearray(plain)
    broken[at[2] - 6] ^= 1  # the second payload
    found = list(warc.salvage(bytes(broken)))
    assert [(x["start"], x["end"], "error" in x) for x in found] == [(at[0], at[1], False), (at[1], at[2], True), (at[2], at[3], False), (at[3], at[4], False)]
    zipped = [warc._member(r) for r in records]
    bad = zipped[0] + zipped[1][: len(zipped[1]) // 2] + b"junk" + zipped[2] + warc.EMPTY_MEMBER + records[3] + zipped[0][:9]
    found = list(warc.salvage(bad))
    assert [x["record"]["payload"] if "record" in x else "gap" for x in found] == [b"one", "gap", b"three", b"four", "gap"]
    assert found[1]["start"] == len(zipped[0]) and sum(x["end"] - x["start"] for x in found) + len(warc.EMPTY_MEMBER) == len(bad)
    assert [("error" in x, x["end"]) for x in warc.salvage(b"no archive")] == [(True, 10)] and list(warc.salvage(b"")) == []


# 4. sharding


@pytest.mark.parametrize("limit", [1 << 30, 400, 50])
def test_sharding_fits(spark, limit):
    texts = [prose(k, 3) for k in range(60)] + ["x" * 1000, None, ""]
    df = docs(spark, texts)
    df = df.unionByName(docs(spark, ["same"] * 40, [7] * 40)).unionByName(docs(spark, ["n"], [None]))
    got = sharding.shard(df.withColumn("shard_id", F.lit("old")), limit).collect()
    assert len(got) == 104
    size, held = Counter(), {}
    for r in got:
        size[r.shard_id] += len((r.text or "").encode())
        held.setdefault(r.shard_id, []).append(r)
    for name, rows in held.items():
        assert all(r.shard_bytes == size[name] for r in rows) and (size[name] <= limit or len(rows) == 1)
    bits = {name.split("#")[0] for name in held}
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    assert sharding.shard(df.filter("false"), limit).count() == 0


# 5. consistent weighted sampling


def test_fingerprints_estimate_generalised_jaccard(spark):
    texts = [prose(k, 80) for k in range(12)] + [None, "", "one", prose(3, 80), "äöü" * 9]
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs(spark, texts)).collect()}
    n, errors = len(texts), []
    bag = lambda t: Counter(zip(words_of(t), words_of(t)[1:])) if len(words_of(t)) > 1 else Counter(words_of(t))
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % n] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[i].near_edited), (nxt, got[i].near_next)):
            a, b = bag(t), bag(other)
            union = sum((a | b).values())
            errors.append(near - (sum((a & b).values()) / union if union else 1.0))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert got[3].fingerprint == got[15].fingerprint and got[12].fingerprint == got[13].fingerprint
    alone = fingerprints.edited_pairs(docs(spark, ["only one here"])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.edited_pairs(docs(spark, [])).count() == 0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    assert all(plain[i] == got[i].fingerprint for i in plain)


# 6. SimHash


def brute_simhash(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, values, budget=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(values[a] ^ values[b]).count("1") <= budget:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark):
    base = [prose(k, 40) for k in range(8)]
    texts = [*base, *(b + " tail" for b in base), *(b.upper() for b in base[:2]), None, "", "two words", "ÄÖ ä"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    values = [brute_simhash(t) for t in texts]
    want = brute_components(list(range(len(texts))), values)
    assert got == {i: (f"{values[i]:016x}", want[i]) for i in range(len(texts))}
    kept = simhash.representatives(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == DOCS.replace(",", "").split()[::2]
    odd = simhash.representatives(docs(spark, ["a b", "a b", "a b", "c d", "c d"], [1, 1, None, None, None]))
    assert sorted((r.doc_id or -1, r.text) for r in odd.collect()) == [(-1, "c d"), (1, "a b")]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("exact,block", [(2, 4096), (3, 4096), (4, 4096), (3, 3)])
def test_pigeonring_loses_no_link(spark, exact, block):
    r = random.Random(exact)
    values = [r.getrandbits(64) for _ in range(30)]
    values += [v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for v in values for _ in range(4)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for row in simhash.links(fps, exact, block=block).collect():
        assert bin((row.a ^ row.b) & (1 << 64) - 1).count("1") <= 4
        x, y = find(row.a), find(row.b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in signed} == brute_components(signed, [v & (1 << 64) - 1 for v in signed])


# 7. toxicity


def test_clauses_and_operators():
    rules = toxicity.grammar()
    of = lambda t: dict(zip(toxicity.KINDS, toxicity.matched_clauses(t, rules)))
    assert of("You are an idiot. Fine.")["insult at target"] == 1
    assert of("what trash")["insult"] == 1
    assert of("you are not an idiot")["insult negated"] == 1
    assert of("he said you are an idiot")["insult reported"] == 1
    assert of("i will kill you")["threat at target"] == 1 and of("i will kill time")["threat at target"] == 0
    assert not any(of("a clean text; nothing here. " * 50).values()) and not any(of("").values())


def test_toxicity_learns_from_its_share_only(spark):
    texts = ["some idiot here", "clean words here", None, "", "worthless scum. trash"] * 20
    labels = spark.createDataFrame([(i, int(i % 5 in (0, 4))) for i in range(100)] + [(1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs(spark, texts), labels).collect()}
    assert all(got[i].predicted == (i % 5 in (0, 4)) and 0 <= got[i].score <= 1 for i in range(100))
    spoiled = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs(spark, texts), spoiled).collect()}
    assert again == {i: got[i].score for i in got}
    none = toxicity.score_documents(docs(spark, texts[:5]), labels.filter("false")).collect()
    # Without labels the grammar's own weights hold: one insult is not enough, two clauses are.
    assert [r.predicted for r in sorted(none, key=lambda r: r.doc_id)] == [0, 0, 0, 0, 1]
    assert toxicity.drop_toxic(docs(spark, texts), labels).count() == 60


# 8. decontamination


def brute_hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for name, item in items:
        v = split(item)
        n = min(len(v), window)
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1 if v else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("window", [3, 10])
def test_decontamination_brute_force(spark, window):
    r = random.Random(window)
    text = lambda n: " ".join(r.choice(["ab", "b", "cé", "d1", "E"]) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 4, 9, 10, 14, 25]))) for k in range(14)] + [(90, ""), (91, None), (5, items_text := text(12)), (92, items_text)]
    texts = [text(n) for n in (0, 1, 5, 30, 120, 400)] + [None, "ab,b;CÉ!", items[4][1].upper() + " zz " + (items[5][1] or "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.match(docs(spark, texts), bench, window=window).collect()}
    assert got == {i: brute_hits(t, items, window) for i, t in enumerate(texts)}
    empty = decontaminate.match(docs(spark, texts), bench.filter("false"), window=window)
    assert empty.filter("n_hit > 0").count() == 0


def test_decontamination_removes_spans(spark):
    item = prose(8, 14)
    clean, holder = prose(9, 40), prose(10, 30) + ".\n" + item.upper() + "! " + prose(11, 30)
    bench = spark.createDataFrame([(1, item), (2, clean.split()[3])], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, [clean, holder, item, None]), bench).collect()}
    assert out[0].text == clean and 2 not in out and out[3].text is None
    assert out[1].text == prose(10, 30) + ".\n" + "! " + prose(11, 30) and out[1].n_chars == len(out[1].text)


# 9. language ID


def test_language_id(spark):
    stems = {"xx": "abcde", "yy": "vwxyz"}
    r = random.Random(1)
    rows = []
    for i in range(240):
        lang = ("xx", "yy", None)[i % 3] if i % 5 else ("xx", "yy")[i % 2]
        letters = stems[lang or "xx"]
        rows.append((i, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20)), lang))
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34 !", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.filter(~langid.held_out()))
    got = {x.doc_id: x for x in langid.predict(df.withColumn("score", F.lit("old")), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang) and {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    assert all(0 <= x.score <= 1 for x in got.values())
    none = langid.predict(df, langid.fit(df.filter("false"))).select("lang_pred").distinct().collect()
    assert [x.lang_pred for x in none] == ["und"]


def test_ngrams_ignore_case_and_runs_of_space():
    a, b = langid.grams("Ab  c1d"), langid.grams("aB c\td")
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


# 10. personal data


def brute_base(t):
    luhn = lambda x: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(x[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(a, z, k) for a, _, k, z in sorted(out)]


def test_base_spans_brute_force():
    r = random.Random(5)
    bits = ["a@b.c", "_", "@", ".", "1.2.3.4", "256", " ", "-", "+", "4111111111111111", "+49 (30) 123-4567", "x", "0", "é", "a.b-c@d-e.f", "7" * 13, "\n"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(t) == brute_base(t), t
    assert pii.base_spans("9" * 50_000 + "a" * 50_000) == []


def test_pii_adds_and_redacts(spark):
    card = "4111111111111111"
    texts = [f"two {card} {card} end", None, "", "mail a.b@c.org now", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', prose(3, 30)]
    df = docs(spark, texts)
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.detect(df.withColumn("spans", F.lit(0)), model).collect()}
    kinds = lambda i: [(s.kind, texts[i][s.start : s.end]) for s in got[i].spans]
    assert kinds(0) == [("card", card), ("card", card)] and not got[0].base
    assert kinds(3) == [("email", "a.b@c.org")] and kinds(4)[0][0] == "secret" and not got[1].spans and not got[5].spans
    out = {r.doc_id: r for r in pii.redact(df, model).collect()}
    assert out[0].text == "two <CARD> <CARD> end" and out[0].n_chars == len(out[0].text) and out[5].text == texts[5] and out[1].text is None


def test_trees_learn_and_calibrate():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    score = trees.predict(trees.fit(x, y), x)
    assert ((score > 0) == y).mean() > 0.95
    a, b = trees.platt(score, y)
    assert a > 0 and abs((1 / (1 + np.exp(-(a * score + b)))).mean() - y.mean()) < 0.05
