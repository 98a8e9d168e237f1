"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Every word enters as a learned word vector joined with the mean of its character-trigram
vectors. A text is cut into overlapping windows of WINDOW words, STRIDE apart; the network
scores all of them, and the highest window decides the text. Training (numpy, Adam) is by
multiple instances: a labelled text's own best window carries its label, chosen anew every
round. A final logistic calibration turns the best window's logit into the chance of the
label. The fitted sample is bounded by ``MAX_TEXTS`` labelled rows, chosen by a hash.

Defined results: null and empty texts, and texts without a word, are scored as one empty
window; labels that are null are not learned from; with training rows of one label only, or
none, every score is the share of that label, held off 0 and 1 by a millionth; repeated rows give repeated rows; other columns
pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm.common import arrow_map, begins, keeps

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
CHAR_BUCKETS = 4096
MAX_VOCABULARY = 20_000
#: Bound of the fitted sample, half of it for each label at most.
MAX_TEXTS = 3_000
#: Words a worker remembers; then it starts anew.
CACHE_WORDS = 100_000
BLOCK = 4_096
SLICE = 256


def trigrams(word: str) -> list[int]:
    raw = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw[i : i + 3]) % CHAR_BUCKETS for i in range(max(1, len(raw) - 2))]


def window_starts(words: int) -> range:
    """Places where windows begin; together they cover every word."""
    return range(0, max(words - WINDOW, 0) + STRIDE, STRIDE) if words > WINDOW else range(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]  # 0 stands for words outside it
    params: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    trained: bool = True

    def digest(self) -> str:
        return hashlib.sha256(pickle.dumps((sorted(self.vocabulary.items()), sorted((k, v.tobytes()) for k, v in self.params.items())))).hexdigest()


def new_params(words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    inner = WORD_DIM + CHAR_DIM
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"word": draw(words + 1, WORD_DIM, scale=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.1)}
    for side in "fb":
        p[f"w{side}"] = draw(inner, 3 * HIDDEN, scale=inner**-0.5)
        p[f"u{side}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        p[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)
    return p | {"att": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}


def _walk(x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """A gated recurrent pass over projected inputs x (T, B, 3H); returns states (T, B, H) and what the gradient needs."""
    steps, rows = x.shape[:2]
    h, out, kept = np.zeros((rows, HIDDEN), np.float32), np.zeros((steps, rows, HIDDEN), np.float32), []
    for t in reversed(range(steps)) if back else range(steps):
        r = h @ u
        gates = _sigmoid(x[t, :, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
        z, s = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
        new = h + mask[t, :, None] * (1 - z) * (n - h)
        kept.append((t, h, r, z, s, n))
        h = new
        out[t] = h
    return out, kept


def _unwalk(kept: list, grad: np.ndarray, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of u, from the gradients of the states."""
    gx, gu = np.zeros((*grad.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u)
    carry = np.zeros(grad.shape[1:], np.float32)
    for t, h, r, z, s, n in reversed(kept):
        d = (grad[t] + carry)
        m = mask[t, :, None]
        dn = d * m * (1 - z) * (1 - n * n)
        dz = -d * m * (n - h) * z * (1 - z)
        ds = dn * r[:, 2 * HIDDEN :] * s * (1 - s)
        gx[t] = np.concatenate([dz, ds, dn], axis=1)
        gr = np.concatenate([dz, ds, dn * s], axis=1)
        gu += h.T @ gr
        carry = d * (1 - m * (1 - z)) + gr @ u.T
    return gx, gu


def _pool(states: np.ndarray, mask: np.ndarray, att: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.where(mask > 0, states @ att, -30.0)
    a = np.exp(e - e.max(axis=0))
    a = a / a.sum(axis=0)
    return a, np.einsum("tb,tbh->bh", a, states)


class Lexicon:
    """Rows of input projections for words, made once for each word that a worker meets. Row 0 is padding."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.both = np.concatenate([model.params["wf"], model.params["wb"]], axis=1)
        self.start = np.concatenate([model.params["cf"], model.params["cb"]])
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)
        self.table[0] = self.start

    def places(self, texts: list[list[str]]) -> np.ndarray:
        """The rows of all words, one text after another."""
        if len(self.rows) > CACHE_WORDS:
            self.forget()
        fresh = [w for w in dict.fromkeys(w for ws in texts for w in ws) if w not in self.rows]
        if fresh:
            self.learn(fresh)
        get = self.rows.__getitem__
        return np.fromiter((get(w) for ws in texts for w in ws), np.int64, sum(map(len, texts)))

    def learn(self, words: list[str]) -> None:
        p, known = self.model.params, self.model.vocabulary
        grams = [trigrams(w) for w in words]
        ends = np.cumsum([0, *map(len, grams)])
        flat = np.fromiter((g for gs in grams for g in gs), np.int64, int(ends[-1]))
        chars = np.add.reduceat(p["char"][flat], ends[:-1], axis=0) / np.diff(ends)[:, None]
        ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        made = np.concatenate([p["word"][ids], chars], axis=1) @ self.both + self.start
        first = len(self.rows) + 1
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(words)] = made
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))


def windows_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: where it begins in the joined words, how many it has, and its text."""
    starts, sizes, owner, base = [], [], [], 0
    for i, n in enumerate(lengths):
        for s in window_starts(n):
            starts.append(base + s)
            sizes.append(min(WINDOW, n - s))
            owner.append(i)
        base += n
    return np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64)


def window_logits(model: ToxicityModel, lexicon: Lexicon, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logit of every window, where it begins, and its text."""
    flat = np.append(lexicon.places(texts), 0)
    starts, sizes, owner = windows_of(list(map(len, texts)))
    p, out = model.params, np.empty(len(starts), np.float32)
    steps = np.arange(WINDOW)
    for k in range(0, len(starts), BLOCK):
        size = sizes[k : k + BLOCK]
        mask = (steps[:, None] < size[None, :]).astype(np.float32)
        at = np.where(mask > 0, starts[None, k : k + BLOCK] + steps[:, None], len(flat) - 1)
        x = lexicon.table[flat[at]]
        states = np.concatenate([_walk(x[:, :, : 3 * HIDDEN], mask, p["uf"], False)[0], _walk(x[:, :, 3 * HIDDEN :], mask, p["ub"], True)[0]], axis=2)
        out[k : k + BLOCK] = _pool(states, mask, p["att"])[1] @ p["out"] + p["bias"]
    return out, starts, owner


def text_logits(model: ToxicityModel, lexicon: Lexicon, texts: list[list[str]]) -> np.ndarray:
    logits, _, owner = window_logits(model, lexicon, texts)
    return np.maximum.reduceat(logits, np.flatnonzero(np.diff(owner, prepend=-1)))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _gradients(model: ToxicityModel, batch: list[list[str]], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    p = model.params
    ids = np.zeros((WINDOW, len(batch)), np.int64)
    mask = np.zeros((WINDOW, len(batch)), np.float32)
    unique = {w: i for i, w in enumerate(dict.fromkeys(w for ws in batch for w in ws))} or {"": 0}
    for b, ws in enumerate(batch):
        ids[: len(ws), b] = [unique[w] for w in ws]
        mask[: len(ws), b] = 1.0
    grams = [trigrams(w) for w in unique]
    ends = np.cumsum([0, *map(len, grams)])
    flat = np.fromiter((g for gs in grams for g in gs), np.int64, int(ends[-1]))
    share = (1 / np.diff(ends))[:, None].astype(np.float32)
    known = np.array([model.vocabulary.get(w, 0) for w in unique])
    vectors = np.concatenate([p["word"][known], np.add.reduceat(p["char"][flat], ends[:-1], axis=0) * share], axis=1)
    x = vectors[ids]
    forward, kept_f = _walk(x @ p["wf"] + p["cf"], mask, p["uf"], False)
    backward, kept_b = _walk(x @ p["wb"] + p["cb"], mask, p["ub"], True)
    states = np.concatenate([forward, backward], axis=2)
    a, context = _pool(states, mask, p["att"])
    d = (weight * (_sigmoid(context @ p["out"] + p["bias"]) - y) / weight.sum()).astype(np.float32)
    g = {"out": context.T @ d, "bias": d.sum(keepdims=True)}
    dc = d[:, None] * p["out"][None, :]
    da = np.einsum("bh,tbh->tb", dc, states)
    de = a * (da - (a * da).sum(axis=0)) * (mask > 0)
    g["att"] = np.einsum("tb,tbh->h", de, states)
    ds = a[:, :, None] * dc[None] + de[:, :, None] * p["att"]
    dx = np.zeros_like(x)
    for side, kept, part in (("f", kept_f, ds[:, :, :HIDDEN]), ("b", kept_b, ds[:, :, HIDDEN:])):
        gx, g[f"u{side}"] = _unwalk(kept, part, mask, p[f"u{side}"])
        g[f"w{side}"] = x.reshape(-1, x.shape[2]).T @ gx.reshape(-1, 3 * HIDDEN)
        g[f"c{side}"] = gx.sum(axis=(0, 1))
        dx += gx @ p[f"w{side}"].T
    dv = np.zeros_like(vectors)
    np.add.at(dv, ids.reshape(-1), (dx * mask[:, :, None]).reshape(-1, x.shape[2]))
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], known, dv[:, :WORD_DIM])
    np.add.at(g["char"], flat, np.repeat(dv[:, WORD_DIM:] * share, np.diff(ends), axis=0))
    return g


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = min(1.0, 5.0 / max(float(np.sqrt(sum((x * x).sum() for x in g.values()))), 1e-12))
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)


def _calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small penalty."""
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + 1e-2 * (w - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


def fit_texts(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 7, rounds: int = 10, rate: float = 0.02, batch: int = 0) -> ToxicityModel:
    """A model of labelled texts; ``weight`` says how many labelled rows each stands for.

    ``batch`` 0 takes a fortieth of the rows, 8 to 64, so that a small sample gets as many steps.
    """
    rng = np.random.default_rng(seed)
    said = [words_of(t) for t in texts]
    seen: dict[str, int] = {}
    ones: dict[str, int] = {}
    for ws, label in zip(said, y, strict=True):
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
            ones[w] = ones.get(w, 0) + int(label)
    common = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:MAX_VOCABULARY]
    model = ToxicityModel({w: i + 1 for i, w in enumerate(common)}, new_params(len(common), rng))
    if not len(y) or y.min() == y.max():
        base = float(np.average(y, weights=weight)) if len(y) else 0.0
        model.trained, model.slope, model.offset = False, 0.0, float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
        return model
    positive, total = float(y.sum()), len(y)
    odds = {w: np.log((ones[w] + 0.5) / (positive + 1)) - np.log((seen[w] - ones[w] + 0.5) / (total - positive + 1)) for w in common}
    adam = Adam(model.params, rate)
    for r in range(rounds):
        adam.rate = rate * (1 - 0.8 * r / rounds)
        chosen: list[list[str]] = []
        if r:
            logits, starts, owner = window_logits(model, Lexicon(model), said)
        base = 0
        for i, ws in enumerate(said):
            places = list(window_starts(len(ws)))
            if r == 0:  # before anything is learned, the words' own log odds choose the window
                best = max(places, key=lambda s: sum(max(odds.get(w, 0.0), 0.0) ** 2 for w in ws[s : s + WINDOW]))
            else:
                best = places[int(logits[base : base + len(places)].argmax())]
            base += len(places)
            chosen.append(ws[best : best + WINDOW])
        rows, labels = list(chosen), list(y)
        for i in np.flatnonzero(y == 0).tolist():  # any window of a clean text is clean
            s = int(rng.choice(list(window_starts(len(said[i])))))
            rows.append(said[i][s : s + WINDOW])
            labels.append(0)
        labels = np.array(labels, np.float32)
        even = np.where(labels == 1, len(labels) / max(labels.sum(), 1), len(labels) / max((1 - labels).sum(), 1)).astype(np.float32)
        order = rng.permutation(len(rows))
        size = batch or min(64, max(8, len(rows) // 40))
        for k in range(0, len(order), size):
            part = order[k : k + size]
            adam.step(_gradients(model, [rows[i] for i in part], labels[part], even[part]))
    best = text_logits(model, Lexicon(model), said)
    model.slope, model.offset = _calibrate(best, y.astype(float), weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model of about MAX_TEXTS labelled documents, half of each label at most, chosen by a hash of their ids.

    ``labels`` are thinned before they meet the texts, so texts aren't shuffled. A document
    that is labelled more than once has its greatest label; of rows of ``docs`` that share an
    id the least text counts.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share, most = F.lit(0.0), MAX_TEXTS / 2
    for k, n in sizes.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, most / n))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    # about MAX_TEXTS rows of two numbers, whatever the size of the tables
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    sample = found.groupBy("id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("id", kind="stable")
    y = (sample["label"].to_numpy() > 0).astype(int)
    got = {k: max(int((sample["label"] == k).sum()), 1) for k in sizes}
    weight = np.array([sizes[k] / got[k] for k in sample["label"]], float)
    return fit_texts(sample["text"].tolist(), y, weight)


_LEXICONS: dict[str, Lexicon] = {}
keeps("toxicity", _LEXICONS.clear)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the chance that each whole text is toxic."""
    kept = [c for c in df.columns if c != out]
    places, at = [df.columns.index(c) for c in kept], df.columns.index(text)
    schema = T.StructType([*(df.schema[i] for i in places), T.StructField(out, T.DoubleType())])
    shared, key = df.sparkSession.sparkContext.broadcast(model), model.digest()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from lyraflux.llm import toxicity

        begins("toxicity")
        arrow, own = to_arrow_schema(schema), shared.value
        if key not in toxicity._LEXICONS:
            toxicity._LEXICONS.clear()
            toxicity._LEXICONS[key] = Lexicon(own)
        lexicon = toxicity._LEXICONS[key]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                logits = text_logits(own, lexicon, [words_of(t) for t in part.column(at).to_pylist()])
                chance = _sigmoid(own.slope * logits.astype(float) + own.offset)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(chance, pa.float64())], schema=arrow)

    return arrow_map(df, run, schema)
