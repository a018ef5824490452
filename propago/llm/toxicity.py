"""Toxicity by a weighted finite-state pattern grammar over clauses; its weights are learned from labels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from propago.llm.arrow import append_columns
from propago.session import cut

# The lexicons of the transducers, in English, German, French and Spanish.
INSULT = "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown clowns imbecile imbeciles dumbass bastard bastards idiota idiotas imbécil imbéciles estúpido estúpida basura patético asqueroso payaso escoria inútil imbécile crétin crétine ordure minable dégoûtant débile connard connasse dummkopf abschaum versager widerlich wertlos trottel arschloch vollidiot"
THREAT = "kill murder hurt shoot stab strangle destroy töten umbringen erschießen verprügeln tuer frapper étrangler matar golpear apuñalar"
TARGET = "you your you're youre yourself he him she her they them these those people du dich dir euch tu toi vous ellos ellas usted ustedes"
NEGATION = "not never isn't aren't wasn't no nicht kein keine keinen nie pas jamais aucun nunca jamás tampoco"
REPORT = "said says say told called quoted wrote reported claims claimed sagte sagt behauptet dit disait écrit appelé dijo dice llamó"

#: What ends the reach of a negation, and what a report needs before what it reports.
CONJUNCTION = "but and or because so though und aber oder weil mais et ou car pero y porque"
COMPLEMENT = "that dass que"

TAGS = {w: tag for tag, words in (("report", REPORT), ("negation", NEGATION), ("target", TARGET), ("threat", THREAT), ("insult", INSULT)) for w in words.split()}
_SIGNS = frozenset((INSULT + " " + THREAT).split())
_CONJUNCTIONS, _COMPLEMENTS = frozenset(CONJUNCTION.split()), frozenset([*COMPLEMENT.split(), *":\"'“”„«»‘’"])
#: Words, commas, colons and quotation marks; a comma is a pause, which only reported speech spans.
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[,:\"“”„«»‘’]|(?<!\w)'|'(?!\w)")
#: Tokens after a report among which its complement must begin.
REACH = 4
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Sentences. Colons and quotation marks stay inside, so that what is quoted is with who said it.
_CLAUSE = re.compile(r"[.!?;\n\r]+")
PAUSE = "pause"

#: What a clause can be; each clause that matches counts for the kind of its heaviest path.
KINDS = (
    "insult", "insult at target", "insult negated", "insult reported", "slur", "slurs", "slur at target", "slur negated", "slur reported",
    "threat at target", "threat negated", "threat reported",
)
#: What the grammar expects of a document's first clause of a kind, and of each doubling of their number, before it has
#: seen labels.
PRIOR = {"insult": (2.5, 1.5), "insult at target": (3.5, 1.0), "threat at target": (3.5, 1.0), "slur": (0.5, 1.5), "slurs": (2.0, 1.0), "slur at target": (1.5, 1.5)}
PRIOR_BIAS = -3.0
#: A word is learned as a slur from so many distinct toxic documents at least, and from this ratio of its rates.
SLUR_DOCUMENTS, SLUR_RATIO = 5, 12.0
#: Independent least word hashes in a document's signature; two of a likeness J share one with the chance J ** SKETCH.
SKETCH = 8
#: Learned slurs of so many bytes at most are shipped to every task; a larger lexicon is joined with the documents' words.
LEXICON_BYTES = 1 << 20
#: Bits of the map of labelled keys, a superset of them, that spares other documents the join; its size is fixed.
MAP_BITS = 24


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer over clause tags.

    ``arcs`` maps (state, tag) to (state, weight); other words stay in a state for ``gap`` words at most, at ``cost``
    each. A pause ends a path unless its state is in ``bridges``. ``ends`` maps a state to what is written there.
    """

    arcs: dict[tuple[int, str], tuple[int, float]]
    ends: dict[int, str]
    gap: int = 4
    cost: float = 0.05
    bridges: frozenset[int] = frozenset()
    start: int = field(default=0)

    def best(self, tags: list[str | None]) -> tuple[str, float] | None:
        """The output with the greatest weight over the paths that start at any word."""
        found: tuple[str, float] | None = None
        live: dict[tuple[int, int], float] = {}
        for tag in tags:
            live[(self.start, 0)] = 0.0
            after: dict[tuple[int, int], float] = {}
            for (state, idle), weight in live.items():
                if state != self.start and idle < self.gap and (tag != PAUSE or state in self.bridges):
                    spot = (state, idle + 1)
                    after[spot] = max(after.get(spot, -1e9), weight - self.cost)
                step = self.arcs.get((state, tag)) if tag else None
                if step:
                    spot, gain = (step[0], 0), weight + step[1]
                    after[spot] = max(after.get(spot, -1e9), gain)
                    if step[0] in self.ends and (found is None or found[1] < gain):
                        found = (self.ends[step[0]], gain)
            live = after
        return found


def act(sign: str, alone: float | None, several: str | None = None) -> Transducer:
    """A sign, alone if ``alone`` is a weight, or next to its target: before it on either side, or, if it cannot stand
    alone, with the target as its object. ``several`` is written where it comes twice."""
    if alone is None:
        return Transducer({(0, sign): (1, 0.0), (1, "target"): (2, 1.0)}, {2: f"{sign} at target"}, gap=2)
    arcs = {(0, sign): (1, alone), (0, "target"): (2, 0.2), (1, "target"): (3, 0.8), (2, sign): (3, 1.0 + alone)}
    ends = {1: sign, 3: f"{sign} at target"}
    if several:
        arcs[(1, sign)], ends[4] = (4, 0.9), several
    return Transducer(arcs, ends)


def after(operator: str, inner: Transducer, written: str, spans_pauses: bool = False) -> Transducer:
    """Composition: the operator's word, then a match of ``inner``; what is written then is ``written`` alone."""
    shift = max(to for to, _ in inner.arcs.values()) + 1
    arcs = {(0, operator): (shift, 1.5)}
    arcs |= {(shift + state, tag): (shift + to, weight) for (state, tag), (to, weight) in inner.arcs.items()}
    bridges = {shift + s for s in inner.bridges} | ({shift} if spans_pauses else set())
    return Transducer(arcs, {shift + s: written for s in inner.ends}, inner.gap, inner.cost, frozenset(bridges))


def then(inner: Transducer, operator: str, written: str) -> Transducer:
    """Composition: a match of ``inner``, then the operator's word, also over pauses; only that writes, ``written``."""
    last = max(to for to, _ in inner.arcs.values()) + 1
    return Transducer(inner.arcs | {(s, operator): (last, 1.5) for s in inner.ends}, {last: written}, inner.gap, inner.cost, inner.bridges | frozenset(inner.ends))


def grammar() -> list[list[Transducer]]:
    """For each sign the plain transducer and its compositions with negation and with reported speech, before or after."""

    def options(sign, plain):
        negated, reported = f"{sign} negated", f"{sign} reported"
        denied = after("negation", plain, negated)
        return [plain, denied, after("report", plain, reported, True), then(plain, "report", reported), after("report", denied, negated, True), then(denied, "report", negated)]

    return [options("insult", act("insult", 1.0)), options("slur", act("slur", 1.0, "slurs")), options("threat", act("threat", None))]


def tags_of(clause: str, slurs: frozenset[str]) -> list[str | None]:
    """The tag of each word and mark of a lower-cased clause; learned words are slurs unless the fixed lexicon has them.

    A report counts if it ends the clause, or a target follows at once, or a complement (that, a colon, quotation marks)
    begins within REACH tokens. A negation reaches no further than a conjunction or a new target before its sign: there
    a pause is put, which ends its path.
    """
    words = _TOKEN.findall(clause)
    out, denied = [], False
    for k, w in enumerate(words):
        tag = PAUSE if w == "," else TAGS.get(w) or ("slur" if w in slurs else None)
        if tag == "report":
            rest = [x for x in words[k + 1 :] if x != ","]
            if rest and TAGS.get(rest[0]) != "target" and _COMPLEMENTS.isdisjoint(rest[:REACH]):
                tag = None
        if denied and (w in _CONJUNCTIONS or tag == "target"):
            out.append(PAUSE)
            denied = False
        if tag == "negation":
            denied = True
        elif tag in ("insult", "slur", "threat"):
            denied = False
        out.append(tag)
    return out


def matched_clauses(text: str, rules: list[list[Transducer]], slurs: frozenset[str] = frozenset()) -> list[int]:
    """How many clauses each kind wins, by the greatest weight among the transducers of a sign."""
    counts = dict.fromkeys(KINDS, 0)
    lowered = text.lower()
    if not (found := set(_WORD.findall(lowered))) or (_SIGNS.isdisjoint(found) and slurs.isdisjoint(found)):
        return [0] * len(KINDS)
    for clause in _CLAUSE.split(lowered):
        tags = tags_of(clause, slurs)
        there = set(tags)
        for options, sign in zip(rules, ("insult", "slur", "threat")):
            matches = [m for t in options if (m := t.best(tags))] if sign in there else []
            if matches:
                counts[max(matches, key=lambda m: m[1])[0]] += 1
    return [counts[k] for k in KINDS]


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)")))


def _labelled(df: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``df`` (__doc) whose key may be in ``known`` (__key): a map of bits of fixed size, joined by slot."""
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} & 63 AS INT))")
    # 2 ** (MAP_BITS - 6) rows at most, whatever the number of labels.
    bits = known.select(slot("__key").alias("at")).select(F.shiftright("at", 6).alias("__word"), bit("at").alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    placed = df.withColumn("__at", slot("__doc")).withColumn("__word", F.shiftright("__at", 6))
    found = placed.join(F.broadcast(bits), "__word").filter(F.col("__bits").bitwiseAND(bit("__at")) != 0)
    return found.drop("__at", "__word", "__bits")


def learn_slurs(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> frozenset[str] | DataFrame:
    """Words that mark the learned rows' toxic labels, beside the fixed lexicons: insults of any language.

    Counted by Spark over all labelled rows that are not held out. Copies, which have all of SKETCH independent least
    word hashes in common, as near copies mostly have, count once, so that a group of copies makes no lexicon. Every
    word that passes counts; over LEXICON_BYTES they stay a DataFrame with the column w. No labels: no words.
    """
    known = labels.filter("toxic IS NOT NULL").select(F.col(f"`{key}`").alias("__key"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = df.select(F.col(f"`{key}`").alias("__doc"), F.col(f"`{text_col}`").cast("string").alias("t")).filter(~held_out("__doc"))
    rows = _labelled(rows, known.filter(~held_out("__key")))
    rows = rows.select("__doc", F.concat_ws(" ", _distinct_words(F.col("t"))).alias("words")).filter("words <> ''")
    # Labels grow with the documents, so they have no bound that would allow a broadcast: both sides are dealt by key.
    rows = rows.join(known.hint("shuffle_merge"), F.col("__doc") == F.col("__key")).select("toxic", F.split("words", " ").alias("words"))
    least = [F.array_min(F.transform("words", lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in range(SKETCH)]
    rows = rows.select("toxic", "words", F.xxhash64(*least).alias("sketch"))
    # The empty word stands in every document: its counts are the totals.
    once = rows.select("sketch", "toxic", F.explode(F.array_append("words", F.lit(""))).alias("w")).groupBy("w", "sketch").agg(F.max("toxic").alias("toxic"))
    counts = once.groupBy("w").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = cut(counts.filter((F.col("pos") >= SLUR_DOCUMENTS) | (F.col("w") == "")))
    total = counts.filter("w = ''").first()
    if total is None:
        return frozenset()
    ratio = ((F.col("pos") + 0.5) / (total.pos + 1)) / ((F.col("n") - F.col("pos") + 0.5) / (total.n - total.pos + 1))
    found = counts.filter("w <> ''").filter(ratio >= SLUR_RATIO).filter(~F.col("w").isin(list(TAGS))).select("w")
    size = found.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    return frozenset(r.w for r in found.collect()) if size <= LEXICON_BYTES else found


def _own_slurs(df: DataFrame, text_col: str, slurs: DataFrame) -> DataFrame:
    """Append ``__slurs``: the words of a text that are in the lexicon, null for none. Copies of a text are joined once."""
    text = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    words = df.select(text.alias("__hash"), F.explode(_distinct_words(F.col(f"`{text_col}`").cast("string"))).alias("w")).distinct()
    own = words.join(slurs, "w").groupBy("__hash").agg(F.collect_list("w").alias("__slurs"))
    return df.withColumn("__hash", text).join(own, "__hash", "left").drop("__hash")


def with_clauses(df: DataFrame, text_col: str = "text", slurs: frozenset[str] | DataFrame = frozenset()) -> DataFrame:
    """Append ``clauses`` (array<int>): counts of matched clauses by kind. Null and empty texts match none."""
    none = [0] * len(KINDS)
    fields = [StructField("clauses", ArrayType(IntegerType()))]
    if isinstance(slurs, DataFrame):

        def make_joined():
            rules = grammar()
            return lambda texts, own: (pa.array([matched_clauses(t, rules, frozenset(s or ())) if t else none for t, s in zip(texts, own)], pa.list_(pa.int32())),)

        return append_columns(_own_slurs(df, text_col, slurs), {text_col: "string", "__slurs": "array<string>"}, fields, make_joined).drop("__slurs")

    def make():
        rules = grammar()
        return lambda texts: (pa.array([matched_clauses(t, rules, slurs) if t else none for t in texts], pa.list_(pa.int32())),)

    return append_columns(df, {text_col: "string"}, fields, make)


def _design(clauses: list[list[int]]) -> np.ndarray:
    """One, and for each kind whether it occurs and how often its clauses doubled."""
    counts = np.array(clauses, float).reshape(len(clauses), len(KINDS))
    each = np.stack([counts > 0, np.log2(np.maximum(counts, 1))], axis=2).reshape(len(counts), -1)
    return np.hstack([np.ones((len(counts), 1)), each])


def fit(labelled: DataFrame, strength: float = 1.0, rounds: int = 60) -> list[float]:
    """Weights (bias first) of a logistic model on (clauses, toxic), with a normal prior at the grammar's own weights.

    Spark counts the labelled rows of each pattern of clause counts; each round of Newton's method sums slopes and
    curvature over the patterns in tasks, so all labels count and the driver holds sums of the model's size. Null labels
    are left out; without labels the prior holds.
    """
    centre = np.array([PRIOR_BIAS, *(PRIOR.get(k, (0.0, 0.0))[n] for k in KINDS for n in (0, 1))])
    patterns = cut(labelled.filter("toxic IS NOT NULL").groupBy("clauses", (F.col("toxic") > 0).cast("int").alias("toxic")).count())
    if patterns.isEmpty():
        return centre.tolist()
    w, d = centre.copy(), len(centre)
    for _ in range(rounds):

        def sums(batches, w=w):
            total = np.zeros(d + d * d)
            for batch in batches:
                x, y, n = _design(batch.column("clauses").to_pylist()), batch.column("toxic").to_numpy(), batch.column("count").to_numpy()
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:d] += x.T @ (n * (p - y))
                total[d:] += ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

        got = np.zeros(d + d * d)
        for r in patterns.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            got[r.i] = r.x
        step = np.linalg.solve(got[d:].reshape(d, d) + strength * np.eye(d), got[:d] + strength * (w - centre))
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    # Sums of doubles come in any order; the digits that they settle are far fewer than these.
    return [round(float(x), 9) for x in w]


def score(clauses: Column, weights: list[float]) -> Column:
    """The chance of toxicity, computed in the JVM: a kind's first clause and each doubling have their own weight."""
    total = F.lit(weights[0])
    for i in range(len(KINDS)):
        n = F.get(clauses, i)
        total = total + F.when(n > 0, F.lit(weights[1 + 2 * i]) + F.lit(weights[2 + 2 * i]) * F.log2(n)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(key: str = "doc_id", parts: int = 5) -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % parts == 0


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, clauses) of each row of ``df``.

    Weights are learned from the labels of the rows that are not held out; a score comes from the text alone. Repeated
    labels count each; rows without a label are scored like any; null keys have no label.
    """
    slurs = learn_slurs(df, labels, key, text_col)
    matched = cut(with_clauses(df.select(F.col(f"`{key}`"), F.col(f"`{text_col}`").alias("__t")), "__t", slurs).drop("__t"))
    known = labels.select(F.col(f"`{key}`").alias("__key"), "toxic")
    weights = fit(matched.filter(~held_out(key)).join(known, F.col(f"`{key}`") == F.col("__key")))
    scored = matched.withColumn("score", score(F.col("clauses"), weights))
    return scored.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def drop_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with a score under one half, columns as they are. The grammar runs once over each text."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    matched = cut(with_clauses(df.select(whole, F.col(f"`{text_col}`").alias("__t")), "__t", learn_slurs(df, labels, key, text_col)).drop("__t"))
    known = labels.select(F.col(f"`{key}`").alias("__key"), "toxic")
    slim = matched.select(F.col(f"row.`{key}`").alias("__doc"), "clauses")
    weights = fit(slim.filter(~held_out("__doc")).join(known, F.col("__doc") == F.col("__key")))
    return matched.filter(score(F.col("clauses"), weights) < 0.5).select("row.*").select(*(F.col(f"`{c}`") for c in df.columns))
