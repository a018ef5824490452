"""The thin queries opN_<name> over the corpus operators, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propago.llm import bpe, centroids, decontaminate, fingerprints, langid, lexical, multiindex, pii, sharding, simhash, substrings, toxicity, warc

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.whole(warc.read(spark, warc.archive(_table(spark, sf_dir, "pages")), payloads=False))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Bytes of text in a shard at most.
SHARD_LIMIT = 1 << 20


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_LIMIT)
    return out.select("doc_id", "shard_id", F.col("shard_depth").cast("long").alias("shard_depth"), "shard_bytes")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, _table(spark, sf_dir, "labels")).drop("clauses")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    out = langid.predict(docs.drop("lang"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.match(docs, _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.detect(docs, pii.fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *map(n, ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark")).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


#: Centroids and rounds of op12, and components of its vectors.
CENTROIDS, ROUNDS, DIMS = 8, 10, 64


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.report(centroids.cluster(_table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, DIMS))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = multiindex.search(multiindex.build(vectors), vectors.filter("vec_id % 50 = 0"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


OP1_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
  FROM words, unnest(range(1, len(w) - 11)) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM windows) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM repeated, unnest(range(0, 13)) AS t(j)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), found AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM words, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i))
  JOIN windows USING (n, win)
), hits AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_hit FROM found, unnest(range(0, n)) AS t(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS largest,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      1 + ((('0x' || hex[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM coded
"""

OP4_SQL = """
WITH hashed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, ('0x' || md5('v' || doc_id)[1:12])::BIGINT AS h FROM documents
), paths AS (
  SELECT doc_id, bytes, d, h >> (48 - d) AS prefix, lpad(bin(h), 48, '0')[1:d] AS bits FROM hashed, unnest(range(0, 41)) AS t(d)
), buckets AS (
  SELECT d, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n FROM paths GROUP BY d, prefix
), leaves AS (
  SELECT doc_id, bits, d, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k
  FROM paths JOIN buckets USING (d, prefix) WHERE shard_bytes <= 1048576 OR n = 1
)
SELECT doc_id, bits AS shard_id, d::BIGINT AS shard_depth, shard_bytes FROM leaves WHERE k = 1
"""
OP11_SQL = """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), tfs AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY doc_id, term
), docs AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs
), lengths AS (
  SELECT doc_id, 100 - 50 + (50 * n * corpus.docs) // corpus.length AS m FROM docs, corpus
), dfs AS (
  SELECT term, floor(1000 * ln((2 * corpus.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, corpus.docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def _op12_sql() -> str:
    """Each round as two tables: every vector's nearest centroid, then the floor means."""
    nearest = """d{r} AS (
  SELECT vec_id, x, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept, c{r}
), a{r} AS (
  SELECT vec_id, x, j, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, j) AS k FROM d{r}) WHERE k = 1
)"""
    means = """m{r} AS (
  SELECT j, list(v ORDER BY i) AS c FROM (
    SELECT j, i, ((s - ((s % n + n) % n)) // n)::BIGINT AS v FROM (SELECT j, i, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT j, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}) GROUP BY j, i)
  ) GROUP BY j
), c{next} AS (
  SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j)
)"""
    rounds = [part.format(r=r, next=r + 1) for r in range(ROUNDS) for part in (nearest, means)]
    tables = ",\n".join([*rounds, nearest.format(r=ROUNDS)])
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: floor({centroids.SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c FROM (SELECT x, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT {CENTROIDS})
),
{tables}
SELECT vec_id, j::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (j)
"""


OP12_SQL = _op12_sql()

QUERIES = {"op1_substrings": op1_substrings, "op2_bpe": op2_bpe, "op3_warc": op3_warc, "op4_sharding": op4_sharding, "op5_fingerprints": op5_fingerprints, "op6_simhash": op6_simhash, "op7_toxicity": op7_toxicity, "op9_langid": op9_langid, "op8_decontaminate": op8_decontaminate, "op10_pii": op10_pii, "op11_lexical": op11_lexical, "op12_centroids": op12_centroids, "op13_multiindex": op13_multiindex}
ORACLES: dict[str, str] = {"op1_substrings": OP1_SQL, "op3_warc": OP3_SQL, "op4_sharding": OP4_SQL, "op8_decontaminate": OP8_SQL, "op11_lexical": OP11_SQL, "op12_centroids": OP12_SQL}
