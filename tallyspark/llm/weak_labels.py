"""A quality classifier from weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer.

Each heuristic votes good (1), bad (-1) or nothing (0) on a document. Documents are counted by their
pattern of votes, in one aggregation over the whole table, and expectation-maximisation over these
counts estimates how often each heuristic is right on good and on bad documents. The posterior of a
pattern is the label of its documents. A linear model over hashed features (runs of characters, runs of
kinds of characters, and repetition) is fitted to the posteriors of a bounded sample of documents; every
document is then scored on its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.words import words
from tallyspark.runtime import materialize

#: Documents the scorer is fitted on: half from each side, those with the smallest text keys.
FIT_ROWS = 8_000
#: Hashed features of each of the two kinds, passes over the fitting rows, and the score from which a document is good.
SIDE, PASSES, THRESHOLD = 1 << 15, 12, 0.5
#: Features that are not hashed: a constant, repeated neighbours, the most frequent word, the share of different words.
PLAIN = 4
#: Words from which a text is judged by itself.
ENOUGH = 20
DIMENSIONS = PLAIN + 2 * SIDE


def profile(text: Column) -> dict[str, Column]:
    """Numbers the heuristics vote on, each taken over the whole text."""
    t, w = F.coalesce(text, F.lit("")), words(text)
    n = F.greatest(F.size(w), F.lit(1))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "n": F.size(w).cast("double"), "again": F.size(F.filter(F.zip_with(w, F.slice(w, 2, n), lambda a, b: a == b), lambda x: x)) / n, "distinct": F.size(F.array_distinct(w)) / n, "short": count(r"(?<![^\x20\x09-\x0D])\p{L}{1,3}(?![^\x20\x09-\x0D])") / n,
        "upper": count(r"\p{Lu}{2,}") / n, "marked": count(r"[*#$%&@^~=<>]{2,}") / n, "shout": count(r"[!?]{2,}") / n, "bars": count(r"[|;\u2022\u00B7\\]") / n, "stops": count(r"[.!?]") / n,
        "odd": count(r"[^\p{L}\p{M}\x20\x09-\x0D]") / F.greatest(F.length(t), F.lit(1)),
    }


def _vote(bad: Column, good: Column | None = None) -> Column:
    c = F.when(bad, -1)
    return (c if good is None else c.when(good, 1)).otherwise(0).cast("tinyint")


def heuristics() -> dict[str, Column]:
    """The labellers, over the columns of ``profile``. They overlap: the detectors of one kind of junk vote bad or
    nothing, the last three vote both ways on what prose has. Repetition is judged against what a text of that
    length may repeat."""
    c = F.col
    usual = F.lit(6.0) / F.sqrt(F.greatest(c("n"), F.lit(20.0)))
    return {
        "symbols": _vote(c("marked") > 0.15),
        "shouting": _vote((c("shout") > 0.15) | (c("upper") > 0.4)),
        "tables": _vote(c("bars") > 0.1),
        "repeats": _vote((c("n") >= 20) & (c("distinct") < F.least(F.lit(0.35), usual * 0.35))),
        "neighbours": _vote((c("n") >= 20) & (c("again") > 0.15)),
        "characters": _vote((c("n") >= 20) & (c("odd") > 0.08), (c("n") >= 20) & (c("odd") < 0.05)),
        "function_words": _vote((c("n") >= 20) & ((c("short") < 0.08) | (c("short") > 0.7)), (c("short") > 0.15) & (c("short") < 0.7)),
        "sentences": _vote((c("n") >= 60) & ((c("stops") < 0.004) | (c("stops") > 0.5)), (c("stops") > 0.02) & (c("stops") < 0.35)),
    }


def text_key(text: Column) -> Column:
    """Equal for equal texts; a null text counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def votes(texts: DataFrame) -> DataFrame:
    """``key, votes`` for the column text: the votes in the order of ``heuristics()``, all 0 for a text without words."""
    p = texts.select(text_key(F.col("text")).alias("key"), *[v.alias(k) for k, v in profile(F.col("text")).items()])
    return p.select("key", F.when(F.col("n") > 0, F.array(*heuristics().values())).otherwise(F.array_repeat(F.lit(0).cast("tinyint"), len(heuristics()))).alias("votes"))


#: Chances of the votes -1, 0, 1 that a labeller starts with, for good and for bad documents; their weight against the documents.
START, ANCHOR = ((0.01, 0.49, 0.5), (0.3, 0.5, 0.2)), 0.005


@dataclass
class LabelModel:
    """``prior`` of good; ``log_odds[j][v]`` is what vote v of labeller j adds to the log odds of good."""

    prior: float
    right: list[tuple[float, float]]
    log_odds: list[dict[int, float]]

    def posterior(self, pattern: list[int]) -> float:
        z = math.log(self.prior / (1 - self.prior)) + sum(o[int(v)] for o, v in zip(self.log_odds, pattern))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_label_model(counts: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.8) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, labellers being independent given the class.

    Each labeller has its own chances of voting -1, 0 and 1 for good and for bad documents. They start
    at ``START``, and pseudo-counts of ``START`` worth ``ANCHOR`` of the documents hold the meaning of
    the two classes. Patterns are at most 3 to the number of labellers, whatever the number of
    documents. Without votes the start is returned.
    """
    k = len(counts[0][0]) if counts else 0
    v = np.array([c[0] for c in counts], int).reshape(len(counts), k)
    n = np.array([c[1] for c in counts], float)
    one_hot = np.stack([v == -1, v == 0, v == 1], 2).astype(float)
    start = np.tile(np.array(START)[:, None, :], (1, k, 1))  # class good / bad, labeller, vote
    theta = start
    for _ in range(rounds if len(counts) else 0):
        joint = np.einsum("pkv,ckv->cp", one_hot, np.log(theta)) + np.log([[prior], [1 - prior]])
        good = 1 / (1 + np.exp(np.clip(joint[1] - joint[0], -500, 500)))
        weights = np.stack([n * good, n * (1 - good)])
        new = np.einsum("cp,pkv->ckv", weights, one_hot) + (1 + ANCHOR * n.sum()) * start
        new /= new.sum(2, keepdims=True)
        prior = float(np.clip(weights[0].sum() / n.sum(), 0.01, 0.99))
        moved, theta = np.abs(new - theta).max(), new
        if moved < 1e-9:
            break
    odds = np.log(theta[0] / theta[1]) if k else np.zeros((0, 3))
    return LabelModel(prior, [(float(theta[0, j, 2] / (theta[0, j, 0] + theta[0, j, 2])), float(theta[1, j, 0] / (theta[1, j, 0] + theta[1, j, 2]))) for j in range(k)], [{-1: float(o[0]), 0: float(o[1]), 1: float(o[2])} for o in odds])


def _kinds() -> np.ndarray:
    """A number for each byte: small letters and bytes above ASCII 1, capitals 2, digits 3, white space 4, other characters from 8."""
    kind = np.ones(256, np.uint32)
    for i in range(128):
        ch = chr(i)
        kind[i] = 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch in " \t\n\v\f\r" else 8 + i
    return kind


_KINDS = _kinds()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Hashed positions of every run of 3 bytes and of 4 kinds of characters, the plain features, and the number of words; None without words."""
    parts = (text or "").split()
    if not parts:
        return None
    n = len(parts)
    b = np.frombuffer(b" " + " ".join(parts).encode("utf-8", "replace") + b"  ", np.uint8)
    x, k = b.astype(np.uint32), _KINDS[b]
    runs = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    kinds = (k[:-3] * np.uint32(0x9E3779B1) ^ k[1:-2] * np.uint32(0x85EBCA77) ^ k[2:-1] * np.uint32(0xC2B2AE3D) ^ k[3:] * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    top = Counter(parts).most_common(1)[0][1]
    plain = np.array([1.0, 3 * sum(map(eq, parts, parts[1:])) / n, top / n if n >= 20 else 0.0, min(1.0, len(set(parts)) / n * math.sqrt(max(n, 20)) / 6)])
    return np.concatenate([runs.astype(np.int64) + PLAIN, kinds.astype(np.int64) + PLAIN + SIDE]), plain, n


def score_text(text: str | None, w: np.ndarray, prior: float) -> float:
    """The model's chance that the text is good; 0 for a text without words.

    A text of fewer than ``ENOUGH`` words is little evidence: its log odds are mixed with those of the prior.
    """
    got = features(text)
    if got is None:
        return 0.0
    hashed, plain, n = got
    z = float(w[hashed].sum()) / len(hashed) * 6 + float(w[:PLAIN] @ plain)
    part = min(1.0, n / ENOUGH)
    z = part * z + (1 - part) * math.log(prior / (1 - prior))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_scorer(texts: list[str | None], posterior: list[float], passes: int = PASSES) -> np.ndarray:
    """Weights of a logistic model over the features, by adaptive gradient steps in the given order; both sides weigh alike."""
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    rows, y = [], []
    for t, p in zip(texts, posterior):
        if (got := features(t)) is None:
            continue
        i, n = np.unique(got[0], return_counts=True)
        rows.append((np.r_[np.arange(PLAIN), i].astype(np.int32), np.r_[got[1], n / len(got[0]) * 6].astype(np.float32)))
        y.append(p)
    good, bad = max(sum(y), 1e-9), max(len(y) - sum(y), 1e-9)
    for _ in range(passes):
        for (i, x), t in zip(rows, y):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ x)))))
            g = (p - t) * (t * len(y) / (2 * good) + (1 - t) * len(y) / (2 * bad)) * x
            g2[i] += g * g
            w[i] -= 0.1 * g / np.sqrt(g2[i])
    return w


@dataclass
class Quality:
    """A fitted classifier: the label model, the scorer's weights, and the table ``key, weak_label`` of all texts."""

    model: LabelModel
    weights: np.ndarray
    labels: DataFrame

    def score(self, spark: SparkSession):  # noqa: ANN201
        """A function of a text column: the score of each text."""
        prior = self.model.prior
        shared = spark.sparkContext.broadcast(self.weights.astype(np.float32))  # DIMENSIONS numbers, whatever the input

        @F.pandas_udf("double")
        def scores(texts):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series([score_text(t, shared.value, prior) for t in texts], dtype=float)

        return scores


def fit_quality(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> Quality:
    """Fit the label model to the votes on all documents, and the scorer to at most ``fit_rows`` of them.

    Of each side (posterior over 0.9, under 0.1) the scorer gets at most half of ``fit_rows``
    documents with a vote, those with the smallest text keys, so reruns agree; only these texts reach
    the driver. Null and empty texts have no votes. Repeated texts are counted as often as they come
    and fitted once. An empty table gives a model that knows nothing and scores every text 0.5.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    voted = materialize(votes(texts), "votes")
    counts = sorted((tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3 ^ 8 rows
    model = fit_label_model(counts)
    z = F.lit(math.log(model.prior / (1 - model.prior))) + sum((F.when(F.get("votes", F.lit(j)) == 1, o[1]).when(F.get("votes", F.lit(j)) == -1, o[-1]).otherwise(o[0]) for j, o in enumerate(model.log_odds)), F.lit(0.0))
    labels = voted.select("key", (1 / (1 + F.exp(-z))).alias("weak_label"), F.exists("votes", lambda v: v != 0).alias("voted"))
    chosen = None
    for sure in (F.col("weak_label") > 0.9, F.col("weak_label") < 0.1):
        side = labels.where(sure & F.col("voted")).select("key", "weak_label").distinct().orderBy("key").limit(fit_rows // 2)
        chosen = side if chosen is None else chosen.unionByName(side)
    chosen = materialize(chosen, "chosen")  # at most fit_rows keys
    picked = texts.withColumn("key", text_key(F.col("text"))).join(F.broadcast(chosen), "key").dropDuplicates(["key"]).collect()
    picked.sort(key=lambda r: r["key"][::-1])  # an order that mixes the two sides
    weights = fit_scorer([r["text"] for r in picked], [r["weak_label"] for r in picked])
    return Quality(model, weights, labels.select("key", "weak_label"))


def keep_good(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns they came with.

    Null, empty and wordless texts score 0 and go; repeated rows stay or go together.
    """
    quality = fit_quality(docs, text_col, fit_rows)
    return docs.where(quality.score(docs.sparkSession)(F.col(f"`{text_col}`")) >= threshold)
