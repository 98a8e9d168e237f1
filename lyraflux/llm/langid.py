"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are sparse: they are learned by follow-the-regularised-leader (proximal form)
with elastic-net penalties, then one temperature is fitted on rows left out of training.
Document frequencies are counted over every training document; the weights are fitted on a
bounded sample of them: of each language SAMPLE_PER_LANG different texts at most, chosen by a
hash of the text, however many copies there are. Every language is learned: the model and the
driver's memory grow with the number of different labels (1 MB each), not with the rows.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
training row every text is ``und``; rows with a null language are scored, not learned from;
ties of two languages go to the first in alphabetical order; repeated rows give repeated
rows; other columns pass through and one named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm.common import SLICE_ROWS, arrow_map, begins

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
MAX_ORDER = 3
#: Bound of the fitted sample: different texts of each language at most.
SAMPLE_PER_LANG = 800
CALIBRATION_SHARE = 5  # one in so many sampled rows fits the temperature
UNDETERMINED = "und"


@dataclass(frozen=True)
class FtrlSettings:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane: itself if it is a letter, else a space."""
    table = np.arange(1 << 16, dtype=np.uint32)
    table[[i for i in range(1 << 16) if not chr(i).isalpha()]] = 32
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the n-grams of a whole text; None where it has no letter."""
    low = text.lower()
    codes = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    if low.isascii() or int(codes.max()) < 1 << 16:
        codes = table[codes]
    else:
        wide = np.array([32 if not chr(c).isalpha() else c for c in codes.tolist()], np.uint32)
        codes = wide
    codes = codes[(codes != 32) | np.concatenate([[True], codes[:-1] != 32])]
    if codes.size < 2 and (codes == 32).all():
        return None
    shift, total, key = np.uint32(32 - BUCKETS_LOG2), None, codes
    for order in range(1, MAX_ORDER + 1):
        if order > 1:
            if codes.size < order:
                break
            key = key[:-1] * np.uint32(0x01000193) + codes[order - 1 :]
        hashed = ((key ^ np.uint32(order * 0x9E37)) * np.uint32(0x9E3779B1)) >> shift
        counts = np.bincount(hashed, minlength=BUCKETS)
        total = counts if total is None else total + counts
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray  # (BUCKETS,)
    weights: np.ndarray  # (BUCKETS, languages)
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        grams = gram_counts(text) if text and self.langs else None
        if grams is None:
            return None
        at, x = _scaled(*grams, self.idf)
        return (x @ self.weights[at]) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        logits = self.logits(text)
        if logits is None:
            return UNDETERMINED, 0.0
        p = _softmax(logits)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def _scaled(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.log1p(counts) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: FtrlSettings) -> np.ndarray:
    """Weights from rows (places, values, class), one pass after another in the order given."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for at, x, y in rows:
            za, na = z[at], n[at]
            w = weights(za, na)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / s.alpha * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    The labels are smoothed as if one row in n + 2 were wrong, so that a perfect separation
    of the rows doesn't turn into certainty.
    """
    doubt = 1.0 / (len(y) + 2)

    def loss(log_t: float) -> float:
        v = logits / np.exp(log_t)
        v = v - v.max(axis=1, keepdims=True)
        v = v - np.log(np.exp(v).sum(axis=1, keepdims=True))
        return float(-((1 - doubt) * v[np.arange(len(y)), y] + doubt * v.mean(axis=1)).mean())

    if not len(y):
        return 1.0
    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", settings: FtrlSettings | None = None) -> LanguageModel:
    """A model of the rows of ``train`` whose language and text are not null."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("key", F.xxhash64("text", F.lit(11)))
    different = rows.select("lang", "key").distinct()
    each = different.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    sizes = {r["lang"]: r["texts"] for r in each.collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))

    def frequencies(batches):
        begins("langid")
        counts, seen = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for t in batch.slice(start, SLICE_ROWS).column(0).to_pylist():
                    grams = gram_counts(t)
                    if grams is not None:
                        counts[grams[0]] += 1
                        seen += 1
        at = np.flatnonzero(counts)
        buckets, n = np.append(at, -1), np.append(counts[at], seen)
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(BUCKETS), 0
    for bucket, n in zip(counted["bucket"], counted["n"], strict=True):
        if bucket < 0:
            total = int(n)
        else:
            df[bucket] = n
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    # Bounded by design: a little more than the share that is wanted, each text once, then exactly that many.
    # A short row a language, as many as the model has columns.
    shares = rows.sparkSession.createDataFrame([(name, min(1.0, 1.25 * SAMPLE_PER_LANG / n)) for name, n in sizes.items()], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").where(F.pmod("key", F.lit(1_000_000)) < F.col("share") * 1_000_000).groupBy("lang", "key").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1_000_000)), "key"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANG)

    def vectors(batches):
        for batch in batches:
            made = [(k, y, g) for k, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (g := gram_counts(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in made], pa.int64()),
                    pa.array([y for _, y, _ in made], pa.string()),
                    pa.array([g[0].astype(np.int32) for _, _, g in made], pa.list_(pa.int32())),
                    pa.array([g[1].astype(np.int32) for _, _, g in made], pa.list_(pa.int32())),
                ],
                names=["key", "lang", "buckets", "counts"],
            )

    sample = picked.select("key", "text", "lang").mapInArrow(vectors, "key long, lang string, buckets array<int>, counts array<int>").toArrow()
    order = np.argsort(sample.column("key").to_numpy(), kind="stable")
    keys, names = sample.column("key").to_pylist(), sample.column("lang").to_pylist()
    buckets, counts = sample.column("buckets"), sample.column("counts")
    at = {name: i for i, name in enumerate(langs)}
    fitted, left = [], []
    for i in order.tolist():
        row = (*_scaled(buckets[i].values.to_numpy(), counts[i].values.to_numpy(), idf), at[names[i]])
        (left if keys[i] // 1_000_000 % CALIBRATION_SHARE == 0 else fitted).append(row)
    fitted = fitted or left
    weights = fit_ftrl(fitted, len(langs), settings or FtrlSettings())
    scores = np.array([x @ weights[a] for a, x, _ in left]).reshape(-1, len(langs))
    temperature = fit_temperature(scores, np.array([y for _, _, y in left], int))
    return LanguageModel(langs, idf, weights.astype(np.float32), temperature)


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score of each whole text. The model has BUCKETS rows and a column a language."""
    made = ("lang_pred", "score")
    kept = [c for c in df.columns if c not in made]
    places, at = [df.columns.index(c) for c in kept], df.columns.index(text)
    schema = T.StructType([*(df.schema[i] for i in places), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        begins("langid")
        arrow, own = to_arrow_schema(schema), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                said = [own.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in places), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                    schema=arrow,
                )

    return arrow_map(df, run, schema)


def rejected(lang: Column, score: Column, least: float = 0.4) -> Column:
    """True for texts without a language, or with one that is hardly likelier than others."""
    return (lang == UNDETERMINED) | (score < least)
