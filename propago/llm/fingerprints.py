"""Document fingerprints by consistent weighted sampling, with DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propago.llm.blocks import NULLS_LAST, QUANTILES, range_block

#: Samples of a signature; the likeness of two has a standard error of sqrt(J * (1 - J) / SAMPLES).
SAMPLES = 64
#: Samples that one row of a term has; more in a row would make generated code too long to be compiled.
PER = 8
BLOCK_DOCS = 512
#: Text bytes in a partition, about: a hash table of one has a few hundred thousand terms.
PART_BYTES = 4 << 20
_CODE = 4
#: Bits of a uniform number: three come from one 64-bit hash.
_BITS = 21


def _uniform(bits: Column, which: int) -> Column:
    """One of three numbers in (0, 2 ** _BITS) that a 64-bit hash has."""
    return F.shiftrightunsigned(bits, _BITS * which).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("double") + F.lit(0.5)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space. Splitting at one plain character is much faster than at a pattern."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def terms(words: Column) -> Column:
    """The 64-bit hashes of the terms, repeats included: pairs of consecutive words, or the only word."""
    code = F.xxhash64
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: code(a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: code(w)))


def weights(rows: DataFrame, group: list[str], text: str, which: Column, texts: int) -> DataFrame:
    """(group, feature, lnw0, lnw1, ...): the terms of each group and the log of their count in each of its texts.

    ``which`` numbers a row's text from 0. A term that a text lacks has a null there; a text without terms has the term -1.
    """
    # Two steps: the words of a text are found once, however often the terms' expression names them.
    each = rows.select(*group, which.alias("which"), words(F.col(text)).alias("words"))
    each = each.select(*group, "which", F.explode_outer(terms(F.col("words"))).alias("feature"))
    count = lambda k: F.nullif(F.sum((F.col("which") == k).cast("long")), F.lit(0))
    each = each.select(*group, "which", F.coalesce("feature", F.lit(-1)).alias("feature"))
    return each.groupBy(*group, "feature").agg(*(F.log(count(k).cast("double")).alias(f"lnw{k}") for k in range(texts)))


def signatures(weighed: DataFrame, group: list[str], texts: int = 1, samples: int = SAMPLES) -> DataFrame:
    """(group, fingerprint0, fingerprint1, ...) by Ioffe's consistent weighted sampling, with term counts as weights.

    A term of weight w gives t = floor(ln w / r + b), y = exp(r * (t - b)) and a = c / (y * exp(r)); a sample keeps the
    term with the least a. Two texts keep the same (term, t) with the chance of their generalised Jaccard similarity; as
    a depends on (term, t) alone, its bits stand for them. r, b and c are hashes of the whole term and the sample, made
    once for all texts of a group. For uniform u, v: r = -ln(u * v) is Gamma(2, 1), b = ln v / ln(u * v) is uniform and
    independent of it, and then a = c * u * exp(-r * t); so the terms of weight 1, where t is 0, need no logarithm but
    that of c, which is Gamma(2, 1) too. A text without terms has the fingerprint of no terms.
    """
    unit = _BITS * math.log(2)
    drawn = weighed.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // PER - 1))).alias("g"))
    seeded = drawn.select("*", F.xxhash64("feature", "g").alias("seed"))
    lnws = [f"lnw{j}" for j in range(texts)]
    of = lambda c, k: F.col(f"{c}{k}")
    bits = [F.xxhash64(F.col("seed").bitwiseXOR(F.lit(2 * k + 1))).alias(f"bits{k}") for k in range(PER)]
    hashed = seeded.select(*group, "g", "seed", *lnws, *bits)
    # f is a at t = 0, in units of 2 ** -_BITS.
    first = [((F.lit(2 * unit) - F.log(_uniform(of("bits", k), 0) * _uniform(of("bits", k), 1))) * _uniform(of("bits", k), 2)).alias(f"f{k}") for k in range(PER)]
    joined = hashed.select("*", *first)

    def a(j: int, k: int) -> Column:
        lnw, lnu = of("lnw", j), F.log(_uniform(of("bits", k), 2)) - F.lit(unit)
        lnv = F.log(_uniform(F.xxhash64(F.col("seed").bitwiseXOR(F.lit(2 * k + 2))), 0)) - F.lit(unit)
        steps = of("f", k) * F.exp((lnu + lnv) * F.floor((lnw - lnv) / -(lnu + lnv)))
        return F.when(lnw == 0, of("f", k)).when(lnw > 0, steps)

    least = [F.min(a(j, k)).alias(f"a{j}_{k}") for j in range(texts) for k in range(PER)]
    code = lambda j, k: F.lower(F.right(F.concat(F.lit("000"), F.hex(F.xxhash64(f"a{j}_{k}"))), F.lit(_CODE)))
    pieces = joined.groupBy(*group, "g").agg(*least)
    pieces = pieces.select(*group, "g", *(F.when(F.col(f"a{j}_0").isNotNull(), F.concat(*(code(j, k) for k in range(PER)))).alias(f"piece{j}") for j in range(texts)))
    whole = lambda j: F.concat(*(F.max(F.when(F.col("g") == g, F.col(f"piece{j}"))) for g in range(samples // PER)))
    return pieces.groupBy(*group).agg(*(whole(j).alias(f"fingerprint{j}") for j in range(texts)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common, an estimate of the generalised Jaccard similarity."""
    same = [(F.substring(a, _CODE * k + 1, _CODE) == F.substring(b, _CODE * k + 1, _CODE)).cast("int") for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def fingerprints(df: DataFrame, key: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint) of every row of ``df``; null texts count as empty, equal texts have equal fingerprints."""
    size = df.select(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    parts = max(1, size // PART_BYTES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__row")).repartition(parts, "__row")
    group = ["__row", "__key"]
    return signatures(weights(rows, group, "__text", F.lit(0), 1), group, 1, samples).select(F.col("__key").alias(key), F.col("fingerprint0").alias("fingerprint"))


def edited_pairs(df: DataFrame, key: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A row's edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    row's, by ascending key, then text; after the last comes the first. Null texts are empty; null keys come last; a
    lone row is its own next. An empty table gives no rows. Keys are integers below 2**63 - 1. Rows are dealt to blocks
    of contiguous keys, each of which also gets the first row of the next block, so no window spans the table; rows of
    one key share a block, and one task sorts a block, on disk if need be.
    """
    n, size, low = df.select(F.count(F.lit(1)), F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.min(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULLS_LAST)))).first()
    if low is None:
        low = NULLS_LAST
    block, n_blocks, cuts = range_block(df, key, max(BLOCK_DOCS, -(-n // QUANTILES)))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART_BYTES)
    k = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULLS_LAST))
    docs = df.select(k.alias("k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"), block.cast("int").alias("block"))
    heads = docs.filter(F.col("k").isin([low, *cuts]))
    heads = heads.groupBy("k", "block").agg(F.min("t").alias("t"))
    heads = heads.select("k", "t", F.pmod(F.col("block") - 1, F.lit(n_blocks)).alias("block"), F.lit(1).alias("ghost"))
    dealt = docs.withColumn("ghost", F.lit(0)).unionByName(heads).repartition(parts, "block")
    w = Window.partitionBy("block").orderBy("ghost", "k", "t")
    # Both uses below read the same columns, so that Spark makes one shuffle of the texts.
    placed = dealt.select("k", "block", "ghost", "t", F.row_number().over(w).alias("rn"), F.lead("t").over(w).alias("next"))
    length = F.length("t")
    cut_at = F.floor(length / 4).cast("int")
    edited = F.when(F.col("ghost") == 0, F.concat(F.substring("t", F.lit(1), length - cut_at), F.substring("next", F.lit(1), cut_at)))
    placed = placed.withColumn("edited", edited)
    both = placed.select("block", "rn", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("e"))
    both = both.select("block", "rn", "e.which", "e.text").filter("text IS NOT NULL")
    signed = signatures(weights(both, ["block", "rn"], "text", F.col("which"), 2), ["block", "rn"], 2, samples)
    signed = signed.select("block", "rn", F.col("fingerprint0").alias("fingerprint"), F.col("fingerprint1").alias("edited_fingerprint"))
    about = placed.select("block", "rn", "ghost", "k", length.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    known = about.join(signed, ["block", "rn"])
    known = known.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("rn"))).filter("ghost = 0")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), samples)
    return known.select(
        F.when(F.col("k") < NULLS_LAST, F.col("k")).alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next")
    )
