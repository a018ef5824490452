"""Byte-level BPE encoding and decoding with tiktoken and a rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from propago.llm.arrow import append_columns, list_of

#: Code points after which a long text is split at the next safe boundary.
CHUNK = 1 << 15
#: No match of the splitting pattern holds white space after another character, or letters and digits together.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])")
#: A run of white space (of Unicode) so long that the pattern's look-ahead may run out of stack.
RUN = 1 << 14
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"(?<![{_SPACE}])[{_SPACE}]{{{RUN},}}")


def ranks_of(spark: SparkSession, path: str):
    """Broadcast the rank file, a few MB whatever the corpus, so that executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}
    return tiktoken.Encoding(hashlib.sha256(data).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _whole(data: bytes) -> tiktoken.Encoding:
    """The same ranks, with a whole text as the only match."""
    return _encoding(data, r"(?s).+")


def pieces(text: str, chunk: int = CHUNK) -> list[tuple[str, bool]]:
    """Split at safe boundaries, so that the pieces' matches of the pattern are those of the whole text.

    A long run of white space is split off by its rule, and marked True as a match of its own: all of it at the end of
    the text, otherwise all but its last character, which goes with what follows.
    """
    out, start = [], 0

    def plain(stop):
        nonlocal start
        while stop - start > chunk:
            cut = SAFE.search(text, start + chunk, stop)
            if not cut:
                break
            out.append((text[start : cut.start()], False))
            start = cut.start()
        out.append((text[start:stop], False))

    if len(text) > RUN:
        for run in _LONG_RUN.finditer(text):
            if run.start() > start:
                plain(run.start())
            start = run.end() - (run.end() < len(text))
            out.append((text[run.start() : start], True))
    if start < len(text) or not out:
        plain(len(text))
    return out


def encode_text(encoding: tiktoken.Encoding, text: str, chunk: int = CHUNK, whole: tiktoken.Encoding | None = None) -> np.ndarray:
    """The ids of a text; ``whole`` encodes long runs of white space, each as one match."""
    parts = [((whole or encoding) if one else encoding).encode_to_numpy(p, disallowed_special=()) for p, one in pieces(text, chunk)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Append ``ids`` (array<int>), ``n_tokens`` (long) and ``ids_sha256`` (hex of the ids as little-endian uint32).

    ``pattern`` is one whose matches hold white space only before other characters or alone, as those of GPT-2.
    Null and empty texts have no ids. Special tokens do not exist: their strings are ordinary text. Repeated rows are
    encoded each; all other columns pass through.
    """
    data = ranks_of(df.sparkSession, ranks_path)

    def make():
        encoding, whole = _encoding(data.value, pattern), _whole(data.value)

        def fn(texts):
            ids = [encode_text(encoding, t or "", chunk, whole) for t in texts]
            digests = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            return list_of([x.astype(np.int32) for x in ids], pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string())

        return fn

    fields = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType())]
    return append_columns(df, {text_col: "string"}, fields, make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Append ``decoded`` (binary): the raw bytes of the ids, which need not be valid UTF-8. Null ids give empty bytes.

    An id outside the vocabulary raises KeyError, as in tiktoken.
    """
    data = ranks_of(df.sparkSession, ranks_path)

    def make():
        encoding = _encoding(data.value, pattern)
        return lambda rows: (pa.array([encoding.decode_bytes(r) if r else b"" for r in rows], pa.binary()),)

    return append_columns(df, {ids_col: "array<int>"}, [StructField("decoded", BinaryType())], make)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ids, n_tokens, ids_sha256, decoded and decoded_sha256."""
    back = decode(encode(df, ranks_path, pattern, text_col), ranks_path, pattern)
    return back.withColumn("decoded_sha256", F.sha2("decoded", 256))
