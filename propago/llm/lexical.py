"""Ranked lexical search: document-sharded CSR postings with integer impacts, scored term at a time by numpy."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from propago.llm.arrow import ROWS, list_of
from propago.session import written

#: A term is a longest run of other characters than these: digits, ASCII letters and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A shard is full at so many bytes of text or documents. Neither bounds the table: shards grow in number.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Bytes of terms in a block of items, which one pass over the shards scores.
BLOCK_BYTES = 4 << 20
#: Bytes of a text whose terms are counted at once.
PIECE = 4 << 20
NO_ID = (1 << 63) - 1

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SHARD = "ids binary, terms array<binary>, dfs array<int>, docs binary, impacts binary"


@dataclass(frozen=True)
class Index:
    """Shards (ids, terms, dfs, docs, impacts), the number of documents with a term, and all their terms."""

    shards: DataFrame
    documents: int
    length: int


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text; memory beyond the text's own is bounded by a piece and the distinct terms."""
    folded, found, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


class _Shard:
    """The postings of a shard while they are gathered, in order of documents."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.vocabulary = array("q"), [], {}
        self.terms, self.docs, self.counts, self.bytes = array("i"), array("i"), array("i"), 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts = term_counts(text)
        if not counts:
            return
        number, known = len(self.ids), self.vocabulary
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(counts.total())
        self.terms.extend([known.setdefault(t, len(known)) for t in counts])
        self.counts.extend(counts.values())
        self.docs.extend([number] * len(counts))
        self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def rows(self, documents: int, length: int) -> pa.RecordBatch:
        """One row: postings by term in order of bytes, then by document."""
        names = sorted(self.vocabulary)
        place = np.empty(len(names), np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term = place[np.frombuffer(self.terms, np.int32)]
        order = np.argsort(term, kind="stable")
        docs, tf = np.frombuffer(self.docs, np.int32)[order], np.frombuffer(self.counts, np.int32)[order].astype(np.int64)
        # Python's integers: 50 * n * N may pass 64 bits, m itself may not.
        m = np.array([100 - 50 + (50 * n * documents) // length for n in self.lengths], np.int64)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
        dfs = np.bincount(term, minlength=len(names)).astype(np.int32)
        columns = [
            pa.array([np.frombuffer(self.ids, np.int64).tobytes()]), pa.array([names], pa.list_(pa.binary())), list_of([dfs], pa.int32()),
            pa.array([docs.tobytes()]), pa.array([impacts.astype(np.int32).tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "dfs", "docs", "impacts"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, written in the shared folder; each task shards the rows that it reads, unshuffled.

    An impact is what a document's length and term frequency give, a term's weight apart: (1e9 * tf) div
    (1000 * tf + 20 * m). Null and termless texts are in no shard and not counted; rows of equal id are documents of
    their own; null ids stay null. Other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    n = F.regexp_count("text", F.lit(TERM))
    documents, length = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    shard.add(doc_id, text)
                    if shard.full():
                        yield shard.rows(documents, length)
                        shard = _Shard()
        if shard.ids:
            yield shard.rows(documents, length)

    shards = rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(gather, _SHARD)
    return Index(written(shards), documents, length)


def document_frequencies(index: Index) -> DataFrame:
    """(term, df): in how many documents a term is."""
    each = index.shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e"))
    return each.groupBy(F.col("e.terms").cast("string").alias("term")).agg(F.sum(F.col("e.dfs").cast("long")).alias("df"))


def weigh(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms array<struct<term, w>>): each item's distinct terms that some document has. Rows of equal id are one item."""
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    asked = items.select(F.col(f"`{id_col}`").alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    # Only asked terms are summed up; the join deals both sides by term.
    known = document_frequencies(index).join(asked.select("term").distinct(), "term", "left_semi")
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(known, "term").groupBy("item").agg(F.collect_list(F.struct("term", w.alias("w"))).alias("terms"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by smaller id: all that beat the k-th, then its ties in order of id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
    above, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]])


def _pass(shards: DataFrame, block: list, kind, k: int) -> DataFrame:
    """(item, doc, score): the best documents of each task's shards for the items of a block."""
    names = sorted({t.term.encode() for row in block for t in row.terms})
    number = {t: i for i, t in enumerate(names)}
    asked = [[(number[t.term.encode()], t.w) for t in row.terms if t.w] for row in block]
    items, arrow = [row.item for row in block], to_arrow_type(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found = pa.array(names, pa.binary()), {}
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[r].as_py(), np.int64)
                docs, impacts = (np.frombuffer(batch.column(c)[r].as_py(), np.int32) for c in (3, 4))
                ends = np.concatenate([[0], np.cumsum(batch.column(2)[r].values.to_numpy(), dtype=np.int64)])
                place = pc.index_in(vocabulary, value_set=batch.column(1)[r].values).to_pylist()
                scores = np.zeros(len(ids), np.int64)
                for i, terms in enumerate(asked):
                    scores[:] = 0
                    for t, w in terms:
                        if place[t] is not None:
                            a, b = ends[place[t]], ends[place[t] + 1]
                            scores[docs[a:b]] += w * impacts[a:b].astype(np.int64)
                    hit = np.flatnonzero(scores)
                    if len(hit):
                        x, y = scores[hit], ids[hit]
                        if i in found:
                            x, y = np.concatenate([found[i][0], x]), np.concatenate([found[i][1], y])
                        top = best(x, y, k)
                        found[i] = x[top], y[top]
        for i, (x, y) in found.items():
            doc = pa.array(y, pa.int64(), mask=y == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([items[i]] * len(x), arrow), doc, pa.array(x, pa.int64())], names=["item", "doc", "score"])

    return shards.mapInArrow(search, f"item {kind.simpleString()}, doc long, score long")


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score): each item's k documents of highest score above 0, equal scores by smaller id, null ids last.

    A score sums a term's weight times its impact over the item's distinct terms, in 64-bit integers. A shard's
    accumulator is dense and its best k are found without a sort; tasks keep k an item over all their shards, and a
    window merges them. Items are dealt to blocks of about BLOCK_BYTES, each a pass over the shards, so the driver and
    the tasks hold one block at a time. Items without known terms, and empty tables, give no rows.
    """
    weighed = written(weigh(index, items, id_col, text_col))
    kind = weighed.schema["item"].dataType
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda total, t: total + F.length(t["term"]) * 4 + 16)
    blocks = max(1, -(-(weighed.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    dealt = weighed.withColumn("block", F.pmod(F.xxhash64(F.col("item").cast(StringType())), F.lit(blocks)))
    parts = [_pass(index.shards, dealt.filter(F.col("block") == b).collect(), kind, k) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")
