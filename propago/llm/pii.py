"""Personal data: exact base patterns, and spans that boosted trees choose among high-recall candidates."""

from __future__ import annotations

import re
from math import log2
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from propago.llm import trees
from propago.llm.arrow import append_columns

#: The order of kinds at the same start.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents whose candidates the trees are fitted on, about; the driver gets their feature rows only.
SAMPLE_DOCS = 2_000
#: Candidates of the sample that the trees are fitted on, at most.
SAMPLE_ROWS = 6_000
#: The least precision on held-out candidates from which a kind's threshold is chosen.
PRECISION = 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(parts) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", end if found else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind, in code points: the leftmost matches that pass their kind's test."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _octets(m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_GROUPS = re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])|(?<![0-9])[0-9]{4}([ -])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?(?![0-9])")
_DIAL = re.compile(r"(?:\+|(?<![0-9])00)[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
_AT = r" ?(?:[\[({] ?at ?[\])}]|(?<= )at(?= )|@) ?"
_DOT = r" ?(?:[\[({] ?dot ?[\])}]|(?<= )dot(?= )|\.) ?"
_SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
#: What every match of _SPELT has from its at on; without it the whole pattern need not be tried.
_SPELT_REST = re.compile(rf"{_AT[2:]}[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-]{{2}}", re.I)
_SAID = re.compile(r"[\[({] ?(?:at|dot) ?[\])}]| dot ", re.I)
_SECRET = re.compile(r"""\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd|key)["']? ?[=:] ?["']?([A-Za-z0-9/+_=-]{8,}(?:\.[A-Za-z0-9/+_=-]{8,})*)""", re.I)
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{24,}+(?![A-Za-z0-9])")

#: Words before a span that speak for its kind; fixed values.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "iban", "account", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd"),
}


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that may be personal data; they may overlap each other and the base spans."""
    out = []
    if any("0" <= c <= "9" for c in text):
        out += [(m.start(), m.end(), "card") for m in _GROUPS.finditer(text)]
        out += [(m.start(), m.end(), "phone") for m in _DIAL.finditer(text)]
        out += [(m.start(), m.end(), "ip") for m in _QUAD.finditer(text)]
        out += [(m.start(), m.end(), "secret") for m in _HEX.finditer(text)]
    if _SPELT_REST.search(text):
        out += [(m.start(), m.end(), "email") for m in _SPELT.finditer(text)]
    if "=" in text or ":" in text:
        out += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    return list(dict.fromkeys(out))


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    span, before = text[start:end], text[max(0, start - 32) : start].lower()
    digits = _digits(span)
    runs = re.findall(r"[0-9]+", span)
    counts = [span.count(c) for c in set(span)]
    entropy = -sum(n / len(span) * log2(n / len(span)) for n in counts)
    edge = lambda c: float(not c or not (c.isalnum() or c in "+@_"))
    return [
        *(float(kind == k) for k in KINDS),
        float(len(digits)),
        float(len(span)),
        float(len(runs)),
        float(max(map(len, runs), default=0)),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else 0.0,
        float(span[:1] == "+" or span[:2] == "00"),
        float(sum(c.isalpha() for c in span)),
        float(span.count("@")),
        float(span.count(".")),
        float(span.count(" ")),
        float(bool(re.search(r"[\[({] ?(?:at|dot) ?[\])}]", span, re.I))),
        float(bool(re.search(r" dot ", span, re.I))),
        float(all(len(r) <= 3 and int(r) <= 255 for r in runs)) if len(runs) == 4 else 0.0,
        entropy,
        edge(text[start - 1 : start]),
        edge(text[end : end + 1]),
        float(any(w in before for w in CONTEXT[kind])),
        float(any(w in before for k in KINDS if k != kind for w in CONTEXT[k])),
    ]


def _weak_label(text: str, base: list[tuple[int, int, str]], span: tuple[int, int, str]) -> float | None:
    """1 if a base span is it, 0 if nothing speaks for it, None if neither is sure."""
    start, end, kind = span
    if kind == "secret":
        named = any(w in text[max(0, start - 16) : start].lower() for w in CONTEXT[kind])
        mixed = any(c.isdigit() for c in text[start:end]) and any(c.isalpha() for c in text[start:end])
        return 1.0 if named and mixed else 0.0 if not mixed else None
    if any(s == span for s in base):
        return 1.0
    if any(s[0] < end and start < s[1] for s in base):
        return None
    if kind == "email" and _SAID.search(text[start:end]):
        return None
    digits = _digits(text[start:end])
    if kind == "card":
        return None if luhn(digits) else 0.0
    return 0.0 if kind in ("ip", "email") or not text[start:end].startswith("+") else None


def training_rows(text: str) -> list[tuple[list[float], float]]:
    base = base_spans(text)
    return [(features(text, *s), y) for s in candidates(text) if (y := _weak_label(text, base, s)) is not None]


def invented_rows(n: int = 400, seed: int = 7) -> list[tuple[list[float], float]]:
    """Invented lines of each kind and of things like it, so that both classes exist on any corpus."""
    draw, out = Random(seed), []
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    name = lambda: "".join(draw.choice("abcdefghiklmnoprstu") for _ in range(draw.randint(3, 8)))
    for _ in range(n):
        card = number(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        wrong = card[:-1] + str((int(card[-1]) + draw.randint(1, 9)) % 10)
        a, b, c = name(), name(), draw.choice(("com", "org", "net", "de", "fr"))
        octets = [draw.randint(0, 255) for _ in range(4)]
        lines = [
            ("card", card, 1), ("card", wrong, 0), ("card", " ".join(card[i : i + 4] for i in range(0, 16, 4)), 1), ("card", number(draw.randint(12, 14)), 0),
            ("email", f"{a}@{b}.{c}", 1), ("email", f"{a} (at) {b} (dot) {c}", 1), ("email", f"{a} (at) {b}.{c}", 1), ("email", f"{a} [at] {b} [Dot] {c}", 1), ("email", f"{a} at {b} dot {c}", 1), ("email", f"{a} at {b}. {name()}", 0),
            ("ip", ".".join(map(str, octets)), 1), ("ip", ".".join(map(str, [draw.randint(256, 999), *octets[1:]])), 0),
            ("phone", f"+{draw.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", 1), ("phone", f"00{draw.randint(1, 99)} {number(3)} {number(3)} {number(4)}", 1), ("phone", f"{number(3)} {number(3)} {number(4)}", 0),
            ("secret", "".join(draw.choice("0123456789abcdef") for _ in range(40)), 1), ("secret", name() + name(), 0),
        ]
        kind, span, y = draw.choice(lines)
        lead = f"{name()} {name()} " + (draw.choice(CONTEXT[kind]) + draw.choice((": ", " = ", " ")) if draw.random() < (0.7 if kind == "secret" and y else 0.3) else "")
        text = f"{lead}{span} {name()}"
        out.append((features(text, len(lead), len(lead) + len(span), kind), float(y)))
    return out


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> dict:
    """Boosted trees, their calibration and a threshold for each kind.

    Weak labels: a candidate that is a base span is positive, one that nothing speaks for is negative, others are left
    out; invented lines are added. ``sample_docs`` documents, about, drawn by a hash of the text, copies once, give candidates.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    drawn = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["t"])

    def run(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() if t for r in training_rows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.float64())], names=["x", "y"])

    found = drawn.mapInArrow(run, "x array<double>, y double").orderBy(F.xxhash64("x"), "y").limit(SAMPLE_ROWS).collect()
    rows = [*((r.x, r.y) for r in found), *invented_rows()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    order = np.random.default_rng(0).permutation(len(y))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 4 == 0
    model = trees.fit(x[~held], y[~held])
    score = trees.predict(model, x[held])
    a, b = trees.platt(score, y[held])
    p = 1 / (1 + np.exp(-(a * score + b)))
    limits = {}
    for i, kind in enumerate(KINDS):
        own = x[held][:, i] == 1
        steps = [t for t in np.arange(0.5, 0.96, 0.05) if (p[own] >= t).any() and y[held][own][p[own] >= t].mean() >= PRECISION]
        limits[kind] = float(min(steps, default=0.95))
    return {"trees": model, "a": a, "b": b, "limits": limits}


def chosen(text: str, model: dict, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The candidates over their kind's threshold that overlap no base span, best first among overlapping ones."""
    found = [s for s in candidates(text) if not any(b[0] < s[1] and s[0] < b[1] for b in base)] if base else candidates(text)
    if not found:
        return []
    p = 1 / (1 + np.exp(-(model["a"] * trees.predict(model["trees"], np.array([features(text, *s) for s in found])) + model["b"])))
    out: list[tuple[int, int, str]] = []
    for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k])):
        s = found[k]
        if p[k] >= model["limits"][s[2]] and not any(o[0] < s[1] and s[0] < o[1] for o in out):
            out.append(s)
    return out


def _order(spans):
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def detect(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append ``base`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive, by start then kind.

    ``spans`` holds every base span and what the model adds. Null and empty texts have none. Other columns pass through;
    input columns named like an output are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(texts):
            bases = [base_spans(t) if t else [] for t in texts]
            alls = [_order([*b, *chosen(t, held.value, b)]) if t else [] for t, b in zip(texts, bases)]
            as_rows = lambda rows: pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in r] for r in rows], _KIND)
            return as_rows(bases), as_rows(alls)

        return fn

    return append_columns(df, {text_col: "string"}, [StructField("base", _SPANS), StructField("spans", _SPANS)], make)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in _order(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind, ``n_chars`` (where there) that of the new text; no row is dropped."""
    held, columns = df.sparkSession.sparkContext.broadcast(model), df.columns

    def make():
        def fn(texts):
            new = []
            for t in texts:
                base = base_spans(t) if t else []
                spans = [*base, *chosen(t, held.value, base)] if t else []
                new.append(redacted(t, spans) if spans else None)
            return (pa.array(new, pa.string()),)

        return fn

    cut = append_columns(df, {text_col: "string"}, [StructField("__new", StringType())], make)
    changed = F.col("__new").isNotNull()
    swap = {text_col: F.coalesce("__new", F.col(f"`{text_col}`"))}
    if "n_chars" in columns:
        swap["n_chars"] = F.when(changed, F.length("__new").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*(swap.get(c, F.col(f"`{c}`")).alias(c) for c in columns))
