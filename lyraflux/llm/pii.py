"""Personal data by weak supervision.

Candidate spans come from four exact base patterns and from looser ones (secrets beside a
key word, opaque tokens, titled names, national numbers). Regex, gazetteer and context
labelers vote on every candidate; expectation-maximisation over the counts of vote patterns
of the whole corpus estimates how reliable each labeler is, for each kind of span and drawn
towards its reliability over all kinds; the posteriors train a logistic
classifier on span features, which decides about the candidates. Base spans always stay.

What reaches the driver is a table of vote and feature patterns, whose size doesn't depend
on the corpus: kinds x 3^labelers x feature levels at most.

Defined results: a null text is the empty text and has no spans; spans are code points, end
exclusive; spans of different kinds may overlap; repeated rows give repeated rows; other
columns pass through, and one named like a result column is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm.common import SLICE_ROWS, arrow_map, begins

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "name", "national_id")
KINDS = BASE_KINDS + EXTRA_KINDS

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

#: The gazetteers.
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key", "bearer")
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Lady", "Rev", "Herr", "Frau", "Fräulein", "Mme", "Mlle", "Madame", "Monsieur", "Maître", "Señor", "Señora", "Señorita", "Don", "Doña", "Sr", "Sra",
)
GIVEN_NAMES = frozenset(
    """james mary john patricia robert jennifer michael linda david elizabeth william susan richard jessica joseph sarah thomas karen charles lisa daniel nancy matthew sandra anthony ashley
    mark emily steven kimberly andrew donna paul michelle kevin laura brian helen george emma edward olivia ronald sophia henry alice peter anna hans klaus jürgen wolfgang dieter uwe stefan
    günter heinz werner monika ursula petra sabine renate heike karin ingrid lukas felix leon hannah mia lena jonas jean pierre michel andré philippe alain bernard jacques françois louis
    nicolas julien marie monique françoise isabelle nathalie sylvie catherine camille chloé léa manon juan josé antonio manuel francisco luis javier carlos miguel pedro pablo diego alejandro
    carmen maría ana isabel dolores pilar teresa lucía sofía paula marta elena""".split()
)
TOP_DOMAINS = frozenset("com org net edu gov mil int io ai app dev co me tv de fr es uk eu at ch it nl be pt pl se no dk fi ie us ca au nz jp cn in br mx ar info biz name".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "correo"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "pay", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": SECRET_WORDS,
    "name": ("name", "dear", "signed", "by", "from"),
    "national_id": ("ssn", "social", "security", "id", "number"),
}
SECRET = re.compile(r"(?i)(?:" + "|".join(map(re.escape, SECRET_WORDS)) + r")\b[\"']?\s{0,4}(?:[=:]|\bis\b)\s{0,4}[\"']?([^\s\"'<>,;]{6,})")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
TITLED = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?\x20([A-Z]\w+(?:\x20[A-Z]\w+)?)")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

LABELERS = ("shape", "gazetteer", "context", "validity", "surroundings")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it: linear, unlike a search from every place."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        # what lies between was no local part of a match; later runs start behind this @
        end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four exact kinds, by kind and start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def extra_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the looser patterns, by kind and start."""
    low = text.lower()
    found = {m.span(1) for m in SECRET.finditer(text)} if any(w in low for w in SECRET_WORDS) else set()
    if DIGIT.search(text) is not None:
        covered = sorted(found)
        for m in OPAQUE.finditer(text):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(a < m.end() and m.start() < b for a, b in covered):
                found.add(m.span())
    out = [("secret", a, b) for a, b in sorted(found)]
    if any(t in text for t in TITLES):
        out += [("name", *m.span(1)) for m in TITLED.finditer(text)]
    if "-" in text:
        out += [("national_id", *m.span()) for m in NATIONAL.finditer(text)]
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One character a labeler: ``+`` personal, ``-`` not, ``0`` no opinion."""
    span = text[start:end]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 8]
    # a title before capitals is as much a pattern as digits in groups
    shape = "+" if base or kind in ("national_id", "name") else "0"
    if kind == "secret":
        shape = "+" if any(c.isdigit() for c in span) else "-"
        known = "+" if any(w in before for w in SECRET_WORDS) else "0"
    elif kind == "email":
        known = "+" if span.rpartition(".")[2].lower() in TOP_DOMAINS else "0"
    elif kind == "name":
        known = "+" if span.split()[0].lower() in GIVEN_NAMES else "0"
    else:
        known = "0"
    words = re.split(r"[^\w-]+", before)
    context = "+" if any(any(w.startswith(c) for c in CONTEXT[kind]) for w in words[-5:] if w) else "0"
    if kind == "card":
        valid = "+" if luhn(NOT_DIGITS.sub("", span)) else "-"
    elif kind == "secret":
        valid = "+" if entropy(span) >= 2.8 else "-"
    elif kind == "ip":
        valid = "-" if span.startswith(("0.", "127.")) else "+"
    elif kind == "national_id":
        valid = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+"
    elif kind == "name":
        valid = "-" if any(c.isdigit() or c == "_" for c in span) or span.isupper() else "0"
    else:
        valid = "0"
    around = "-" if before.endswith(("/", "#")) or after[:1] in ("/", "(") or "http" in before[-12:] else "0"
    return shape + known + context + valid + around


def features(text: str, kind: str, start: int, end: int) -> str:
    """Coarse levels of length, digits and neighbours, as text."""
    span = text[start:end]
    size, digits = end - start, sum(c.isdigit() for c in span) / max(end - start, 1)
    edge = (start == 0 or text[start - 1].isspace()) + 2 * (end == len(text) or not text[end].isalnum())
    return f"{min(size // 8, 5)}{min(int(digits * 4), 3)}{edge}{int(any(c.isupper() for c in span))}"


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, key) of each candidate; the key joins kind, votes and features."""
    if not text:
        return []
    out = []
    for spans, base in ((base_spans(text), True), (extra_spans(text), False)):
        out += [(k, a, b, base, f"{k}|{votes(text, k, a, b, base)}|{features(text, k, a, b)}") for k, a, b in spans]
    return out


@dataclass(frozen=True)
class SpanModel:
    #: By kind, for each labeler: how often its vote is right, when it votes.
    reliability: dict[str, np.ndarray]
    prior: dict[str, float]
    weights: dict[str, float] = field(default_factory=dict)

    def keeps(self, key: str, base: bool) -> bool:
        return base or self.chance(key) >= 0.5

    def chance(self, key: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(self.weights.get(f, 0.0) for f in span_features(key))))))


def span_features(key: str) -> list[str]:
    kind, vote, levels = key.split("|")
    named = [f"{n}:{v}" for n, v in zip(LABELERS, vote, strict=True)]
    return ["bias", f"kind:{kind}", *named, *(f"level{i}:{v}" for i, v in enumerate(levels))]


#: Votes that all kinds together count for in the reliabilities of one kind, and an opinion beforehand (share right, votes).
POOLED_VOTES, FIRST_SHARE, FIRST_VOTES = 20.0, 0.75, 4.0


def fit_em(patterns: dict[str, int], rounds: int = 50, pooled: np.ndarray | None = None) -> tuple[np.ndarray, float, dict[str, float]]:
    """How often each labeler is right, the prior and the posterior of each vote pattern, from pattern counts.

    A labeler that has no opinion says nothing, so one that can't judge a kind doesn't count
    there; none is taken to be worse than a coin. ``pooled`` shares count as POOLED_VOTES votes more.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    cast = np.array([["+0-".index(c) for c in k] for k in keys]).reshape(len(keys), len(LABELERS))
    yes, no = (cast == 0).astype(float), (cast == 2).astype(float)
    before, votes = (np.full(len(LABELERS), FIRST_SHARE), FIRST_VOTES) if pooled is None else (pooled, POOLED_VOTES)
    # A first opinion: the majority of the votes. It tells which of the two classes is the personal one.
    post = 1 / (1 + np.exp(-(yes.sum(axis=1) - 1.5 * no.sum(axis=1) - 0.5) * 2))
    right, prior = before, 0.5
    for _ in range(rounds if keys else 0):
        prior = float(np.clip((n @ post) / n.sum(), 0.05, 0.95))
        agrees = (n * post) @ yes + (n * (1 - post)) @ no
        right = np.clip((agrees + votes * before) / (n @ (yes + no) + votes), 0.5, 0.99)
        odds = math.log(prior / (1 - prior)) + (yes - no) @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return right, prior, dict(zip(keys, post.tolist(), strict=True))


def fit_classifier(counts: dict[str, int], post: dict[str, float], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> dict[str, float]:
    """Weights of the span classifier, from soft labels weighted by the logarithm of how often a key occurs."""
    keys = sorted(counts)
    names = sorted({f for k in keys for f in span_features(k)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for r, k in enumerate(keys):
        x[r, [place[f] for f in span_features(k)]] = 1.0
    y = np.array([post[k.rpartition("|")[0]] for k in keys])
    n = np.log1p(np.array([counts[k] for k in keys], float))
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds if keys else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) / n.sum() + l2 * w
        squares += g * g
        w -= rate * g / np.sqrt(squares)
    return dict(zip(names, w.tolist(), strict=True))


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """The model of all candidates of all texts; only counts of their keys are collected."""

    def keyed(batches):
        begins("pii")
        for batch in batches:
            found: Counter[str] = Counter()
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for t in batch.slice(start, SLICE_ROWS).column(0).to_pylist():
                    found.update(c[4] for c in candidates(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])

    rows = docs.select(text).mapInArrow(keyed, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return fit_counts({r["key"]: r["n"] for r in rows})


def fit_counts(counts: dict[str, int]) -> SpanModel:
    """The model of candidates by key (kind, votes and features), from how often each key occurs."""
    pooled: Counter[str] = Counter()
    by_kind: dict[str, Counter[str]] = {}
    for k, n in counts.items():
        kind, vote, _ = k.split("|")
        pooled[vote] += n
        by_kind.setdefault(kind, Counter())[vote] += n
    table, _, _ = fit_em(pooled)
    fitted = {kind: fit_em(own, pooled=table) for kind, own in by_kind.items()}
    post = {f"{kind}|{vote}": p for kind, (_, _, own) in fitted.items() for vote, p in own.items()}
    return SpanModel({k: f[0] for k, f in fitted.items()}, {k: f[1] for k, f in fitted.items()}, fit_classifier(counts, post))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
)


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find_spans(df: DataFrame, model: SpanModel, text: str = "text", redact: bool = False) -> DataFrame:
    """``df`` with ``pii_spans`` (kind, start, end, base), by kind and start; ``redact`` also rewrites the text."""
    kept = [c for c in df.columns if c != "pii_spans"]
    places, at = [df.columns.index(c) for c in kept], df.columns.index(text)
    schema = T.StructType([*(df.schema[i] for i in places), T.StructField("pii_spans", SPANS)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        begins("pii")
        arrow, own, chosen = to_arrow_schema(schema), shared.value, {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts, found = part.column(at).to_pylist(), []
                for t in texts:
                    spans = []
                    for kind, a, b, base, key in candidates(t):
                        if (key, base) not in chosen:
                            chosen[key, base] = own.keeps(key, base)
                        if chosen[key, base]:
                            spans.append({"kind": kind, "start": a, "end": b, "base": base})
                    found.append(spans)
                columns = [part.column(i) for i in places]
                if redact:
                    clean = [t if not t or not s else redacted(t, s) for t, s in zip(texts, found, strict=True)]
                    columns[places.index(at)] = pa.array(clean, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field("pii_spans").type)], schema=arrow)

    return arrow_map(df, run, schema)
