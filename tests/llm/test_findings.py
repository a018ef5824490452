"""Cases in which an operator once did less than the whole job."""

import gzip
import itertools
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from propago.llm import bpe, decontaminate, fingerprints, langid, pii, queries, toxicity, warc

DOCS = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return [("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))) for _ in range(n)]


def test_slurs_count_documents_that_share_a_common_word(spark, monkeypatch):
    pool = spark.createDataFrame([(w,) for w in sorted(set(prose(1, 5000)))], "w string")
    # The common word has the least hash of all, so one least hash cannot tell the documents apart.
    common = pool.orderBy(F.xxhash64("w")).first().w
    words = [w for w in sorted(set(prose(2, 20_000))) if w != common]
    texts = [" ".join([common, *random.Random(k).sample(words, 30), *(["zorgl"] if k % 4 == 0 else [])]) for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    assert toxicity.learn_slurs(df, labels) == {"zorgl"}
    copies = spark.createDataFrame([(k, texts[0] if k % 4 == 0 else t) for k, t in enumerate(texts)], DOCS)
    assert toxicity.learn_slurs(copies, labels) == frozenset()
    want = {r.doc_id: r.clauses for r in toxicity.score_documents(df, labels).collect()}
    monkeypatch.setattr(toxicity, "LEXICON_BYTES", 0)
    assert {r.doc_id: r.clauses for r in toxicity.score_documents(df, labels).collect()} == want
    assert toxicity.drop_toxic(df, labels).columns == df.columns


def test_slurs_have_no_fixed_number(spark):
    slurs = [f"zz{a}{b}{c}" for a in "abcdefghijk" for b in "abcdefghij" for c in "abcdefghij"]
    r = random.Random(1)
    words = sorted(set(prose(3, 20_000)))
    # Each toxic document has its own part of the slurs: eleven hundred are learned.
    texts = [" ".join([*r.sample(words, 20), *(r.sample(slurs, 300) if k % 4 == 0 else [])]) for k in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)], "doc_id long, toxic int")
    assert set(slurs) <= toxicity.learn_slurs(df, labels)


def test_short_items_quoted_in_longer_text_are_removed(spark):
    item, three = prose(4, 6), prose(5, 3)
    single = prose(6, 4)
    before, after = prose(7, 40), prose(8, 40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(three)), *((10 + k, w) for k, w in enumerate(single))], "item_id long, text string")
    texts = [" ".join(before + x + after) for x in (item, three, single, item + three)]
    got = {r.doc_id: r.text.split() for r in decontaminate.decontaminate(spark.createDataFrame(list(enumerate(texts)), DOCS), bench).collect()}
    assert got == {0: before + after, 1: texts[1].split(), 2: texts[2].split(), 3: before + three + after}


def test_spelt_addresses_need_no_other_sign(spark):
    texts = ["write to jane (at) example.com today", "write to jane [at] example [Dot] com today", "ask jane at example Dot com today", "we met at home. Then we left"]
    spans = [[t[a:b] for a, b, kind in pii.candidates(t) if kind == "email"] for t in texts]
    assert spans[0] == ["jane (at) example.com"] and spans[1][0].startswith("jane [at] example [Dot] com") and spans[2][0].startswith("jane at example Dot com")
    for t in texts:
        there = pii._SPELT.search(t)
        assert not there or pii._SPELT_REST.search(t)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    out = {r.doc_id: r.text for r in pii.redact(df, pii.fit(df)).collect()}
    assert "jane" not in out[0] and "jane" not in out[1] and out[3] == texts[3]


def test_long_unrelated_texts_look_unrelated(spark):
    texts = [" ".join(f"{tag}{k}" for k in range(30_000)) for tag in "ab"]
    got = fingerprints.edited_pairs(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert all(r.near_next <= 0.05 for r in got) and all(abs(r.near_edited - 0.6) < 0.25 for r in got)


def test_salvage_within_members():
    records = [warc._record("response", k, "u", warc.digest32(p), len(p), warc._response(p)) for k, p in enumerate([b"one", b"two", b"three" * 2000, b"four"])]
    payloads = lambda found: [x["record"]["payload"] if "record" in x else "gap" for x in found]
    bad = bytearray(records[1])
    bad[-6] ^= 1
    after = gzip.compress(records[0])
    assert payloads(warc.salvage(gzip.compress(records[0] + bytes(bad) + records[3]) + after)) == [b"one", "gap", b"four", b"one"]
    for level in (0, 6):
        whole = gzip.compress(b"".join(records), level)
        assert payloads(warc.salvage(whole)) == [b"one", b"two", b"three" * 2000, b"four"]
        assert payloads(warc.salvage(whole[:-12])) in ([b"one", b"two", b"three" * 2000, "gap"], [b"one", b"two", b"three" * 2000, b"four", "gap"])
        wrong = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
        assert payloads(warc.salvage(wrong + after)) == [b"one", b"two", b"three" * 2000, b"four", "gap", b"one"]


RANKS = public_tokenizers.path(queries.RANKS)


def test_long_white_space_is_one_match():
    with open(RANKS, "rb") as f:
        data = f.read()
    encoding, whole = bpe._encoding(data, public_tokenizers.PATTERN), bpe._whole(data)
    assert isinstance(encoding, tiktoken.Encoding)
    n = bpe.RUN + 5
    for text in (" " * n, "a" + " " * n + "b", "a" + "\n" * n + "b c", " \t" * n + ".", "\u2003" * n, "x" * 40_000 + " " * n + "7" * 40_000 + " " * n):
        assert bpe.encode_text(encoding, text, whole=whole).tolist() == encoding.encode(text), repr(text[:3])
    huge = "a" + " " * 5_000_000 + "b"
    ids = bpe.encode_text(encoding, huge, whole=whole)
    assert encoding.decode(ids.tolist()) == huge and ids[-1] == encoding.encode(" b")[0]


def test_archives_are_bounded_by_bytes_and_damage_is_quarantined(spark, tmp_path):
    r = random.Random(1)
    pages = [(k, "http://x/%d" % k, "".join(r.choice("abcdefghij ") for _ in range(r.choice([10, 5_000, 60_000])))) for k in range(60)]
    pages[0] = (0, "http://x/0", pages[1][2])
    path = str(tmp_path / "warc")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("mine")).coalesce(1)
    warc.write(df, path, file_bytes=50_000)
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) > 5 and max(map(os.path.getsize, files)) <= 50_000
    rows = {x.id: x for x in warc.whole(warc.read(spark, path)).collect()}
    assert len(rows) == 60 and rows[0].record_type == "revisit" and rows[0].refers_to == 1
    assert all(rows[k].payload.decode() == html for k, _, html in pages[1:])
    victim = max(files, key=os.path.getsize)
    os.remove(os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc"))
    with open(victim, "rb+") as f:
        f.seek(os.path.getsize(victim) // 2)
        f.write(b"\x00" * 64)
    found = warc.read(spark, path)
    kept = {x.id for x in found.filter("error IS NULL").collect()}
    assert 55 <= len(kept) < 60 and found.filter("error IS NOT NULL").count() >= 1
    warc.log_gaps(found, str(tmp_path / "gaps"))
    assert set(spark.read.json(str(tmp_path / "gaps")).columns) == {"file", "start", "end", "error"}
    with pytest.raises(Exception, match="damaged archive"):
        warc.whole(found).collect()


def brute_best(t, tags):
    """The heaviest path by trying every choice of words that a transducer may read."""
    best = None

    def go(state, at, idle, weight):
        nonlocal best
        if at == len(tags):
            return
        tag = tags[at]
        if state != t.start and idle < t.gap and (tag != toxicity.PAUSE or state in t.bridges):
            go(state, at + 1, idle + 1, weight - t.cost)
        step = t.arcs.get((state, tag)) if tag else None
        if step:
            gain = weight + step[1]
            if step[0] in t.ends and (best is None or gain > best):
                best = gain
            go(step[0], at + 1, 0, gain)

    for start in range(len(tags)):
        go(t.start, start, 0, 0.0)
    return best


def test_transducers_against_all_paths():
    r = random.Random(2)
    names = ["insult", "slur", "threat", "target", "negation", "report", toxicity.PAUSE, None, None]
    for _ in range(400):
        tags = [r.choice(names) for _ in range(r.randint(1, 9))]
        for t in itertools.chain(*toxicity.grammar()):
            found, want = t.best(tags), brute_best(t, tags)
            assert (found is None) == (want is None) and (found is None or abs(found[1] - want) < 1e-9), tags


def test_negation_and_report_compose_over_learned_words():
    rules, slurs = toxicity.grammar(), frozenset(["zorg"])
    of = lambda t: {k: n for k, n in zip(toxicity.KINDS, toxicity.matched_clauses(t, rules, slurs)) if n}
    assert of("he said you are not a zorg") == {"slur negated": 1} and of("you zorg") == {"slur at target": 1}
    assert of('He said: "you are an idiot"') == {"insult reported": 1} == of("You are an idiot, he said.")
    assert of("kill the process, you know") == {} and of("I will never kill you") == {"threat negated": 1}
    assert of("a zorg. a zorg. a zorg. a zorg") == {"slur": 4} and of("") == {} == of(", , ,")


@pytest.mark.parametrize("shard_bytes", [40, 1 << 20])
def test_shards_of_items_against_each_other(spark, shard_bytes):
    items = [(k, " ".join(prose(50 + k, 14))) for k in range(6)] + [(90, " ".join(prose(50, 14)[:3]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(prose(9, 20) + prose(51, 14) + prose(10, 5) + prose(54, 14)[2:13]), " ".join(prose(50, 14)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("items", F.lit("old"))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.match(df, bench, shard_bytes=shard_bytes).collect()}
    assert got == {0: (25, ["1", "4"]), 1: (14, ["0", "90"]), 2: (0, []), 3: (0, [])}


def test_calibration_has_an_inner_optimum():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 500)
    sure = np.eye(3)[y] * 4 + r.normal(size=(500, 3)) * 0.1
    t = langid.temperature(sure, y)
    assert 0.05 < t < 20
    noisy = np.eye(3)[np.where(r.random(500) < 0.7, y, (y + 1) % 3)] * 10
    p = np.exp(noisy / langid.temperature(noisy, y))
    assert abs((p.max(axis=1) / p.sum(axis=1)).mean() - 0.7) < 0.05
    assert langid.temperature(np.zeros(0), y[:0]) == 1.0


@pytest.mark.parametrize("n", [80, 2_000, 20_000])
def test_likeness_is_the_jaccard_similarity(spark, n):
    a, b = [f"a{k}" for k in range(n)], [f"b{k}" for k in range(n)]
    texts = [" ".join(a), " ".join(b), " ".join(a[: n // 2] + b[: n // 2])]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    pairs = [set(zip(t.split(), t.split()[1:])) for t in texts]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        want = len(pairs[i] & pairs[j]) / len(pairs[i] | pairs[j])
        seen = np.mean([got[i][k : k + 4] == got[j][k : k + 4] for k in range(0, 256, 4)])
        assert abs(seen - want) <= 3 * max(0.125, np.sqrt(want * (1 - want))) / 8


CONTRACTS = {
    "op1_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_queries_keep_their_contracts(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    want = dict(x.split() for x in CONTRACTS[name].split(", "))
    assert {k: found.get(k) for k in want} == want
    table = "pages" if name == "op3_warc" else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
