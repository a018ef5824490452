"""Benchmark decontamination: a generalised suffix automaton of the items, through which document words stream."""

from __future__ import annotations

import hashlib
import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from propago.llm.arrow import append_columns
from propago.session import cut

WINDOW = 10
#: The pipeline cuts items of so many words at most from no longer text.
EXEMPT = 3
#: Bytes of item text in one automaton, about: more items are dealt to several, each of which passes over the documents.
SHARD_BYTES = 4 << 20
#: Word bytes are digits, letters (A-Z lower-cased) and all of non-ASCII; others become spaces.
_WORD_BYTES = bytes((c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Builder:
    """Suffix automaton of all items' word sequences, with the windows that end in each state; see ``arrays``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.items = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, codes in self.items:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self._mark()

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, c, q)
        new = self._state(self.longest[last] + 1)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.step[p][c]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.longest.append(length)
        return len(self.step) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.longest[p] + 1)
        self.step[new] = dict(self.step[q])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def _mark(self) -> None:
        """For each state: the items with a window that ends there, by window length, from its own and shorter suffixes."""
        full: dict[int, set[int]] = {}  # of the state that holds a full-length window
        short: dict[int, list[tuple[int, int]]] = {}  # of the state of a whole item that is shorter
        for number, (_, codes) in enumerate(self.items):
            state, length = 0, 0
            for c in codes:
                state, length = self.step[state][c], length + 1
                while self.longest[self.link[state]] >= self.window:
                    state = self.link[state]
                    length = self.longest[state]
                if length >= self.window:
                    full.setdefault(state, set()).add(number)
            if len(codes) < self.window:
                short.setdefault(state, []).append((len(codes), number))
        self.full, self.short = full, short

    def arrays(self) -> dict[str, np.ndarray]:
        """The automaton as flat arrays: transitions sorted by (state, word), and each state's nearest suffix with items."""
        size, n = len(self.step), max(1, len(self.vocabulary))
        edges = sorted((s * n + c, to) for s, step in enumerate(self.step) for c, to in step.items())
        full_at, short_at = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for s in sorted(range(size), key=self.longest.__getitem__):
            above = max(self.link[s], 0)
            full_at[s] = s if s in self.full else full_at[above] if s else -1
            short_at[s] = s if s in self.short else short_at[above] if s else -1
        pairs = {a * n + b for _, codes in self.items for a, b in zip(codes, codes[1:])}
        lists = {"full": [(s, i) for s in sorted(self.full) for i in sorted(self.full[s])], "short": [(s, *x) for s in sorted(self.short) for x in sorted(self.short[s])]}
        return {
            "edge": np.array([e[0] for e in edges], np.int64), "to": np.array([e[1] for e in edges], np.int32),
            "link": np.array(self.link, np.int32), "longest": np.array(self.longest, np.int32), "full_at": full_at, "short_at": short_at,
            "full": np.array(lists["full"], np.int32).reshape(-1, 2), "short": np.array(lists["short"], np.int32).reshape(-1, 3),
            "pairs": np.array(sorted(pairs), np.int64), "words": _joined(self.vocabulary), "names": _joined(name.encode() for name, _ in self.items),
            "least": np.array(min((min(len(w), self.window) for _, w in self.items), default=0)),
        }


def _joined(values) -> np.ndarray:
    return np.frombuffer(b"".join(len(v).to_bytes(4, "little") + v for v in values), np.uint8)


def _split(data: np.ndarray) -> list[bytes]:
    raw, at, out = data.tobytes(), 0, []
    while at < len(raw):
        end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : end])
        at = end
    return out


class Automaton:
    """A built automaton, through which words stream."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int) -> None:
        self.window = window
        self.vocabulary = {w: k for k, w in enumerate(_split(arrays["words"]))}
        self.names = [x.decode() for x in _split(arrays["names"])]
        self.least = int(arrays["least"])
        for name in ("edge", "to", "link", "longest", "full_at", "short_at", "full", "short", "pairs"):
            setattr(self, name, arrays[name])

    def _next(self, state: int, c: int) -> int:
        """The state after a word, or -1."""
        code = state * max(1, len(self.vocabulary)) + c
        at = int(self.edge.searchsorted(code))
        return int(self.to[at]) if at < len(self.edge) and self.edge[at] == code else -1

    def _of(self, table: np.ndarray, state: int) -> np.ndarray:
        """The rows of a list by state."""
        return table[table[:, 0].searchsorted(state) : table[:, 0].searchsorted(state, "right"), 1:]

    def _stretches(self, codes: np.ndarray):
        """Maximal runs of words that may hold a window: known words, each pair of which some item has."""
        known = codes >= 0
        joined = np.zeros(len(codes) + 1, bool)  # word k goes on from word k-1
        if len(codes) > 1 and len(self.pairs):
            pair = codes[:-1] * max(1, len(self.vocabulary)) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:-1] = known[:-1] & known[1:] & (self.pairs[at] == pair)
        starts, stops = np.flatnonzero(known & ~joined[:-1]), np.flatnonzero(known & ~joined[1:]) + 1
        long_enough = stops - starts >= self.least
        return zip(starts[long_enough].tolist(), stops[long_enough].tolist())

    def scan(self, words: list[bytes], floor: int = 1) -> tuple[np.ndarray, set[int], int, np.ndarray]:
        """Which words windows cover, the numbers of items with occurring windows, the longest match in words, and which
        words windows of ``floor`` words or more cover."""
        hit, short = np.zeros(len(words) + 1, np.int32), np.zeros(len(words) + 1, np.int32)
        found: set[int] = set()
        longest = 0
        if not self.names or len(words) < self.least:
            return hit[:-1] > 0, found, longest, hit[:-1] > 0
        codes = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        for start, stop in self._stretches(codes):
            state = length = 0
            for at, c in enumerate(codes[start:stop].tolist(), start):
                while (after := self._next(state, c)) < 0 and state:
                    state = int(self.link[state])
                    length = int(self.longest[state])
                if after >= 0:
                    state, length = after, length + 1
                longest = max(longest, length)
                if length >= self.window:
                    hit[at + 1 - self.window] += 1
                    hit[at + 1] -= 1
                    if self.full_at[state] >= 0:
                        found.update(self._of(self.full, self.full_at[state])[:, 0].tolist())
                near = int(self.short_at[state])
                while near >= 0:
                    for size, number in self._of(self.short, near).tolist():
                        if size <= length:
                            into = hit if size >= floor else short
                            into[at + 1 - size] += 1
                            into[at + 1] -= 1
                            found.add(number)
                    near = int(self.short_at[self.link[near]]) if near else -1
        core = np.cumsum(hit[:-1]) > 0
        return core | (np.cumsum(short[:-1]) > 0), found, longest, core


@lru_cache(maxsize=1)
def _automaton(key: str, data: bytes, window: int) -> Automaton:
    with np.load(io.BytesIO(data)) as arrays:
        return Automaton({k: arrays[k] for k in arrays.files}, window)


def build(benchmark: DataFrame, window: int, item_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """(shard, data): the automata of the items. A hash deals the items to shards; one task builds a shard's automaton."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t")).filter("item IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def make(table):
        rows = sorted(zip(table.column("item").to_pylist(), table.column("t").to_pylist()))
        out = io.BytesIO()
        np.savez(out, **Builder([(name, words_of(t)) for name, t in rows], window).arrays())
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "data": pa.array([out.getvalue()], pa.binary())})

    return items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(make, "shard int, data binary")


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))


def match(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, item_col: str = "item_id", item_text: str = "text", floor: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Append n_words, n_hit, longest (words of the longest match), items (array of item ids as strings, sorted), spans.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A word
    inside any occurrence of a window is hit; ``spans`` are the maximal runs of words hit by windows of ``floor`` words
    or more. Null texts have no words; null items or item ids are left out; repeated items count by their id. Other
    columns pass through; input columns named like an output are replaced. A task holds one automaton, of about
    ``shard_bytes`` of item text. Items beyond that are matched in further passes over the documents, each written and
    read again, in which hits are united; so there is no bound on the items.
    """
    outputs = ("n_words", "n_hit", "longest", "items", "spans")
    marked = df.drop(*outputs, "__hits").withColumns({"spans": F.lit(None).cast(_SPANS), "__hits": F.lit(None).cast(_SPANS), "items": F.lit(None).cast("array<string>"), "longest": F.lit(0).cast("long")})
    automata = cut(build(benchmark, window, item_col, item_text, shard_bytes))
    shards = sorted(r.shard for r in automata.select("shard").collect())
    for k, shard in enumerate(shards or [-1]):
        data = automata.filter(F.col("shard") == shard).first()  # one shard's flat arrays, a bounded number of bytes
        marked = _pass(marked, bytes(data["data"]) if data else None, text_col, window, floor)
        if k + 1 < len(shards):
            marked = cut(marked)
    return marked.select(*(c for c in df.drop(*outputs, "__hits").columns), *outputs)


def _mask(spans: list | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for s in spans or ():
        out[s["start"] : s["stop"]] = True
    return out


def _runs(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
    return [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])]


def _pass(df: DataFrame, data: bytes | None, text_col: str, window: int, floor: int) -> DataFrame:
    """Unite what one automaton matches with what the columns of ``match`` hold already."""
    held = df.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data)) if data else None

    def make():
        automaton = _automaton(*held.value, window) if held else None

        def fn(texts, hits, spans, items, longest):
            n_words, n_hit, out_hits, out_spans, out_items, out_longest = [], [], [], [], [], []
            for t, before, core_before, names, most in zip(texts, hits, spans, items, longest):
                words = words_of(t or b"")
                mask, core, found = _mask(before, len(words)), _mask(core_before, len(words)), set(names or ())
                if automaton:
                    hit, numbers, m, whole = automaton.scan(words, floor)
                    mask, core, most = mask | hit, core | whole, max(most, m)
                    found |= {automaton.names[k] for k in numbers}
                n_words.append(len(words))
                n_hit.append(int(mask.sum()))
                out_hits.append(_runs(mask))
                out_spans.append(_runs(core))
                out_items.append(sorted(found))
                out_longest.append(most)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            return pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(out_longest, pa.int64()), pa.array(out_items, pa.list_(pa.string())), pa.array(out_spans, kind), pa.array(out_hits, kind)

        return fn

    fields = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("longest", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", _SPANS), StructField("__hits", _SPANS)]
    fed = df.withColumn("__bytes", F.col(f"`{text_col}`").cast("string"))
    span = "array<struct<start:int,stop:int>>"
    return append_columns(fed, {"__bytes": "binary", "__hits": span, "spans": span, "items": "array<string>", "longest": "long"}, fields, make).drop("__bytes")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, and without what stands between words of one span."""
    blank = text.translate(_WORD_BYTES)
    out, kept, number, at = [], 0, -1, 0
    ends = iter([*spans, (1 << 60, 1 << 60)])
    start, stop = next(ends)
    inside = 0
    while at < len(blank):
        while at < len(blank) and blank[at] == 0x20:
            at += 1
        if at == len(blank):
            break
        end = blank.find(b" ", at)
        end = len(blank) if end < 0 else end
        number += 1
        if number == start:
            inside = at
        if number == stop - 1:
            out.append(text[kept:inside])
            kept = end
            start, stop = next(ends)
            if start > 1 << 59:
                break
        at = end
    return b"".join([*out, text[kept:]])


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_words: int = EXEMPT, max_coverage: float = 0.5) -> DataFrame:
    """Remove what windows of over ``max_words`` words match; drop documents of which more than ``max_coverage`` is hit.

    A shorter item is one window, so it is removed wherever it is quoted whole. Only items of ``max_words`` words at
    most, such as one common word, are cut from no longer text that they occur in, not even side by side.
    Other documents keep their exact text. Columns as in ``df``; ``n_chars``, where there, is that of the new text.
    """
    columns = df.columns
    # Rows go as structs, so that no column of theirs can clash with what is appended.
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    marked = match(whole, benchmark, "__text", window, floor=max_words + 1).withColumn("__cover", F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0)))
    kept = marked.filter(F.col("__cover") <= max_coverage).withColumn("__bytes", F.col("__text"))

    def make():
        def fn(texts, spans):
            new = [_without(t, [(s["start"], s["stop"]) for s in x]) if x and t is not None else t for t, x in zip(texts, spans)]
            return (pa.array(new, pa.binary()).cast(pa.string()),)

        return fn

    new = append_columns(kept.withColumn("__spans", F.col("spans")), {"__bytes": "binary", "__spans": "array<struct<start:int,stop:int>>"}, [StructField("__new", StringType())], make)
    changed = F.size("__spans") > 0
    swap = {text_col: F.when(changed, F.col("__new")).otherwise(F.col(f"row.`{text_col}`"))}
    if "n_chars" in columns:
        swap["n_chars"] = F.when(changed, F.length("__new").cast("long")).otherwise(F.col("row.n_chars"))
    return new.select(*(swap.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))
