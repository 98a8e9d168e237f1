"""Mixing sources to target weights with soft domain membership.

1. A labelled table names the domain of some documents. Their text features (shares of
   letters, signs, capitals, length) give a Gaussian naive Bayes classifier; what it says of
   every document is a posterior over the domains, tempered so that it stays soft.
2. Projected-gradient least squares fits a nonnegative rate for every document, so that the
   expected tokens of each domain, the sum of rate x tokens x posterior, match the targets.
   A step is one aggregation over all documents (a sum a domain); the rates themselves never
   leave the executors: each row replays the steps, and the table is written anew after
   every SETTLE of them. Steps go on until every total is within TOLERANCE of its target, or
   until PATIENCE of them bring nothing more: then targets can't be met, the step that came
   nearest counts (the start, if none came nearer), ``converged`` is false in every row and a
   warning says so.

Everything is DataFrame and SQL functions. The driver holds a few numbers a domain.

Defined results: a null text is the empty one, with no tokens; documents without a label are
scored, not learned from; a document labelled more than once counts in each of its domains;
null domains are no labels; without any labelled document all belong to one domain named
``all``; a domain of target 0 gets rates down to 0; rows that share an id or repeat get
rates of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyraflux.llm.common import cut_lineage

#: The characters whose shares are features.
MARKS = "e a o n s t h w k z u q y é è ü ä ß ó ñ í ! , @".split()
#: Sums of one aggregation; more are made by several.
SUMS = 400
#: Share of what domains hold that is added to their Gram matrix before it weighs errors: nearly inseparable domains can't ask for huge rates.
RIDGE = 0.02
#: How many features say the same thing: the evidence of all of them is divided by it.
TEMPERATURE = 10.0
SETTLE, PATIENCE, TOLERANCE = 8, 24, 1e-3


def text_features(text: Column) -> dict[str, Column]:
    """Shares of characters, each as an expression; ``size`` is the logarithm of the length."""
    n = F.length(text)
    share = lambda kept: (n - F.length(kept)) / F.greatest(n, F.lit(1))
    out = {f"f{i}": share(F.replace(text, F.lit(c), F.lit(""))) for i, c in enumerate(MARKS)}
    out["capitals"] = share(F.regexp_replace(text, "[A-Z]+", ""))
    out["size"] = F.log1p(n)
    return out


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\t-\r]+")).cast("long")


class Domains:
    """A Gaussian naive Bayes classifier: for each domain its prior, and mean and variance of each feature."""

    def __init__(self, names: list[str], priors: list[float], means: list[list[float]], variances: list[list[float]], features: list[str]) -> None:
        self.names, self.priors, self.means, self.variances, self.features = names, priors, means, variances, features

    def evidence(self, temperature: float = TEMPERATURE) -> Column:
        """The logarithm of every domain's posterior but for a constant, as an array, from the feature columns."""
        scores = []
        for prior, mean, variance in zip(self.priors, self.means, self.variances, strict=True):
            at = F.lit(math.log(prior) * temperature - 0.5 * sum(map(math.log, variance)))
            for f, m, v in zip(self.features, mean, variance, strict=True):
                at = at - (F.col(f) - m) * (F.col(f) - m) * (0.5 / v)
            scores.append(at / temperature)
        return F.array(*scores)


def fit_domains(labelled: DataFrame, features: list[str], domain: str = "domain") -> Domains:
    """The classifier of all rows of ``labelled`` (the feature columns and ``domain``); one row a domain is collected: domains are named by people."""
    rows = labelled.where(F.col(domain).isNotNull())
    aggs = [f(c).alias(f"{k}_{c}") for c in features for k, f in (("mean", F.avg), ("var", F.var_pop))]
    got = rows.groupBy(domain).agg(F.count(F.lit(1)).alias("n"), *aggs).orderBy(domain).collect()
    if not got:
        return Domains(["all"], [1.0], [[0.0] * len(features)], [[1.0] * len(features)], features)
    total = sum(r["n"] for r in got)
    # a domain's variance is drawn towards that of all domains, as if eight more of its rows had it
    pooled = {c: sum(r["n"] * r[f"var_{c}"] for r in got) / total + 1e-7 for c in features}
    spread = [[(r["n"] * r[f"var_{c}"] + 8 * pooled[c]) / (r["n"] + 8) + 1e-9 for c in features] for r in got]
    return Domains([r[domain] for r in got], [r["n"] / total for r in got], [[r[f"mean_{c}"] for c in features] for r in got], spread, features)


def _sums(rows: DataFrame, of: list[Column]) -> list[float]:
    """The sum of each column over all rows, 0 without any."""
    out: list[float] = []
    for k in range(0, len(of), SUMS):
        out += [float(x or 0.0) for x in rows.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(of[k : k + SUMS])]).first()]
    return out


def _totals(rows: DataFrame, rate: Column, k: int) -> list[float]:
    """Tokens of each domain at a rate: sum of rate x tokens x posterior."""
    return _sums(rows, [rate * F.col("mix_tokens") * F.col(f"mix_p{i}") for i in range(k)])


def _pulled(pull: list[float]) -> Column:
    """The sum of posteriors times ``pull``."""
    return sum((F.col(f"mix_p{i}") * x for i, x in enumerate(pull)), F.lit(0.0))


def error_weights(rows: DataFrame, before: list[float]) -> np.ndarray:
    """The inverse of the domains' Gram matrix with RIDGE times what each has at rate 1 on its diagonal.

    With these weights a step of size 1 never overshoots (no eigenvalue is above 1), and where
    no rate has to stop at 0 and domains are separable it is nearly the last.
    """
    k = len(before)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = _sums(rows, [F.col("mix_tokens") * F.col(f"mix_p{i}") * F.col(f"mix_p{j}") for i, j in pairs])
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, found, strict=True):
        gram[i, j] = gram[j, i] = x
    held = np.array(before) > 0
    out = np.zeros((k, k))
    if held.any():
        out[np.ix_(held, held)] = np.linalg.inv(gram[np.ix_(held, held)] + RIDGE * np.diag(np.array(before)[held]))
    return out


def fit_rates(rows: DataFrame, targets: list[float], before: list[float], patience: int = PATIENCE, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[list[float]], bool]:
    """``rows`` (mix_tokens, mix_p0 ..., mix_rate as the start) with fitted ``mix_rate``; the totals at each step, last those of the rates returned; whether they meet the targets.

    Least squares of the totals' errors, weighed by ``error_weights``, by accelerated projected
    gradient. Rates move in a metric that weighs a document by its tokens, so its length doesn't
    decide its rate. The step whose greatest error is least is returned, never one worse than the start.
    """
    k = len(targets)
    held = [i for i in range(k) if before[i] > 0]
    weigh = error_weights(rows, before)
    bound = [max(t, 1e-9 * sum(targets), 1e-9) for t in targets]
    history: list[list[float]] = []
    rate, ahead, momentum = F.col("mix_rate"), F.col("mix_rate"), 1.0
    least, best, since = math.inf, (rows, []), 0
    while True:
        totals = _totals(rows, ahead, k)
        history.append(totals)
        miss = max([abs(totals[i] - targets[i]) / bound[i] for i in held] or [0.0])
        since = 0 if miss < 0.99 * least else since + 1
        if miss < least:
            least, best = miss, (rows.withColumn("mix_rate", ahead), totals)
        if least <= tolerance or since >= patience:
            if least > tolerance:
                warnings.warn(f"token totals stay {100 * least:.2g} % from their targets", stacklevel=2)
            if history[-1] != best[1]:
                history.append(best[1])
            return best[0], history, least <= tolerance
        pull = (weigh @ (np.array(totals) - np.array(targets))).tolist()
        rows = rows.withColumn("mix_next", F.greatest(F.lit(0.0), ahead - _pulled(pull)))
        faster = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        lead = (momentum - 1) / faster
        momentum = faster
        rows = rows.withColumn("mix_ahead", F.greatest(F.lit(0.0), F.col("mix_next") + lead * (F.col("mix_next") - rate)))
        rows = rows.withColumn("mix_rate", F.col("mix_next")).drop("mix_next")
        ahead = F.col("mix_ahead")
        if len(history) % SETTLE == 0:
            rows = cut_lineage(rows)


def tempered_targets(names: list[str], totals: list[float], power: float = 0.7, favour: Callable[[str], float] = lambda name: 1.0) -> list[float]:
    """Targets in tokens: weights are shares to ``power`` times ``favour``; as many tokens as leave every
    domain of full favour all that it has."""
    whole = sum(totals)
    weights = [favour(n) * (t / whole) ** power if whole > 0 else 0.0 for n, t in zip(names, totals, strict=True)]
    budget = max([t / w for n, t, w in zip(names, totals, weights, strict=True) if w > 0 and favour(n) >= 1.0] or [0.0])
    return [budget * w for w in weights]


def document_rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Callable[[list[str], list[float]], list[float]] = tempered_targets,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row for each row of ``docs``: its id, n_tokens, domain (the likeliest), posterior (its chance), rate and copies; and what they come from.

    posteriors holds the chances of all domains in alphabetical order; domain_target and
    domain_total are the tokens wanted and reached in the row's domain, as the sum of
    rate x n_tokens x posterior; converged tells whether all totals are within TOLERANCE.
    ``labelled`` has the ids of some documents and their ``domain``; ``targets`` takes the domains
    and the tokens that they have and returns the tokens wanted. copies rounds the rate up or
    down by a hash of the id, so that its mean is the rate.
    """
    own = text_features(F.coalesce(F.col(text), F.lit("")))
    tokens = token_count(F.coalesce(F.col(text), F.lit("")))
    # the texts are read once; from here on rows carry numbers only
    small = cut_lineage(docs.select(F.col(id_col).alias("mix_id"), tokens.alias("mix_tokens"), *[e.alias(f) for f, e in own.items()]))
    known = labelled.select(F.col(id_col).alias("mix_id"), "domain").distinct()
    model = fit_domains(small.join(known, "mix_id"), list(own))
    k = len(model.names)
    raw = small.select("mix_id", "mix_tokens", model.evidence().alias("logs"))
    raw = raw.withColumn("most", F.array_max("logs")).withColumn("raw", F.transform("logs", lambda x: F.exp(x - F.col("most"))))
    raw = raw.withColumn("whole", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    chances = [(F.col("raw")[i] / F.col("whole")).alias(f"mix_p{i}") for i in range(k)]
    start = cut_lineage(raw.select("mix_id", "mix_tokens", *chances, F.lit(1.0).alias("mix_rate")))
    before = _totals(start, F.lit(1.0), k)
    wanted = targets(model.names, before)
    rows, history, met = fit_rates(start, wanted, before)
    rows = rows.withColumn("mix_p", F.array(*[F.col(f"mix_p{i}") for i in range(k)]))
    rows = rows.withColumn("mix_at", (F.array_position("mix_p", F.array_max("mix_p")) - 1).cast("int"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("mix_at"))
    draw = F.pmod(F.xxhash64("mix_id", F.lit(6)), F.lit(1 << 20)) / (1 << 20)
    return rows.select(
        F.col("mix_id").alias(id_col), F.col("mix_tokens").alias("n_tokens"), of(model.names).alias("domain"), F.array_max("mix_p").alias("posterior"), F.col("mix_rate").alias("rate"),
        F.floor(F.col("mix_rate") + draw).cast("int").alias("copies"), F.col("mix_p").alias("posteriors"), of(wanted).alias("domain_target"), of(history[-1]).alias("domain_total"), F.lit(met).alias("converged"),
    )


def resampled(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` as often as its copies say; rows that share an id share the least of their numbers. Columns of any name pass through."""
    times = rates.groupBy(F.col(id_col).alias("id")).agg(F.min("copies").alias("copies")).where("copies > 0")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = own.join(times, own["row"][id_col].eqNullSafe(times["id"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
