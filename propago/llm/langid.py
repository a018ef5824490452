"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from propago.llm.arrow import append_columns

#: Hashed n-grams of one to three letters; document frequencies and weights have this many entries at most.
FEATURES = 1 << 14
#: Labelled documents that the weights are learned from, about; document frequencies are counted over all of them.
SAMPLE_DOCS = 4_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and counts of the lower-cased text's n-grams; what is no letter is one space. No letter: none."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[a] if len(a) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.where(letter, a, 32).astype(np.uint64)
    a = np.concatenate(([32], a[np.concatenate(([True], letter[1:] | letter[:-1]))], [32])).astype(np.uint64)
    two = a[:-1] * np.uint64(0x1F123BB5) + a[1:] + np.uint64(1 << 40)
    three = two[:-1] * np.uint64(0x2545F491) + a[2:] + np.uint64(1 << 41)
    code = np.concatenate((a, two, three)) * np.uint64(0x9E3779B97F4A7C15)
    seen = np.bincount((code >> np.uint64(64 - 14)).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(seen)
    return at, seen[at]


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % parts == part


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each feature the documents that have it, over all rows of ``texts`` (t), and the number of rows."""

    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total[grams(t or "")[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1])), pa.int32()), pa.array(np.concatenate((total[at], [n])), pa.int64())], names=["feature", "n"])

    rows = texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r.feature: r.n for r in rows}
    total = found.pop(-1, 0)
    out = np.zeros(FEATURES, np.int64)
    out[list(found.keys())] = list(found.values())
    return out, total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's features and their TF-IDF weights, of length one."""
    at, n = grams(text)
    x = (1 + np.log(n)) * idf[at] if len(at) else np.zeros(0)
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights (classes x FEATURES + 1; the last is the bias) by follow-the-regularised-leader with an elastic net."""
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            after = ns + g * g
            z[:, at] = zs + g - (np.sqrt(after) - np.sqrt(ns)) / alpha * w
            n[:, at] = after
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood on rows not learned from.

    Targets are smoothed as if each other language had been seen once more, so that rows that are all right have a
    finite optimum. Raises if the optimum is at an end of the search. One language alone, or no row, gives 1.
    """
    n, k = logits.shape if logits.ndim == 2 else (0, 0)
    if n == 0 or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)
    steps = np.geomspace(0.01, 100, 241)
    losses = []
    for t in steps:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        losses.append(float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean()))
    best = int(np.argmin(losses))
    if best in (0, len(steps) - 1) and np.ptp(logits) > 0:
        raise ValueError(f"calibration ends at the edge of its search: {steps[best]}")
    return float(steps[best])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict:
    """Document frequencies over all rows of ``df`` with a language; weights and temperature from about ``sample_docs``.

    The sample is drawn by a hash of the text, copies once, so a drawn text with many copies stays one row. It is in
    proportion to the languages, but a rare one gets a quarter of an even share, or all it has. A tenth of the
    sample sets the temperature only. Rows without language or letter are left out. Without any row the model knows no
    language.
    """
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang IS NOT NULL AND t IS NOT NULL")
    df_counts, total = document_frequencies(rows.select("t"))
    idf = np.log((1 + total) / (1 + df_counts)) + 1
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    kinds = max(1, sizes.count())
    share = F.greatest(F.lit(sample_docs / max(1, total)), F.lit(sample_docs / (4 * kinds)) / F.col("n"))
    shares = sizes.select("lang", F.least(F.lit(1.0), share).alias("share"))
    # As many rows as the model has classes, which every task holds anyway.
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < (F.col("share") * (1 << 30)).cast("long")).select("t", "lang").dropDuplicates(["t", "lang"])

    def run(batches):
        for batch in batches:
            found = [(lang, at.astype("<i4").tobytes(), n.astype("<f4").tobytes()) for t, lang in zip(*(c.to_pylist() for c in batch.columns)) for at, n in [vector(t, idf)] if len(at)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["lang", "at", "x"])

    got = sorted(drawn.mapInArrow(run, "lang string, at binary, x binary").collect(), key=lambda r: (bytes(r.x), r.lang))
    langs = sorted({r.lang for r in got})
    if not langs:
        return {"langs": [], "idf": idf, "weights": np.zeros((0, FEATURES + 1)), "temperature": 1.0}
    sample = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), langs.index(r["lang"])) for r in got]
    learn, calibrate = [s for i, s in enumerate(sample) if i % 10], [s for i, s in enumerate(sample) if i % 10 == 0]
    w = ftrl(learn or sample, len(langs))
    logits = np.array([w[:, at] @ x + w[:, -1] for at, x, _ in calibrate])
    return {"langs": langs, "idf": idf, "weights": w, "temperature": temperature(logits, np.array([y for *_, y in calibrate]))}


def predict(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (its calibrated chance). Null texts and texts without a letter: und, 0."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        langs, idf, w, t = m["langs"], m["idf"], m["weights"], m["temperature"]

        def one(text):
            at, x = vector(text or "", idf)
            if not len(at) or not langs:
                return UNKNOWN, 0.0
            s = (w[:, at] @ x + w[:, -1]) / t
            p = np.exp(s - s.max())
            k = int(p.argmax())
            return langs[k], float(p[k] / p.sum())

        def fn(texts):
            found = [one(x) for x in texts]
            return pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())

        return fn

    return append_columns(df, {text_col: "string"}, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make)
