"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other sampled texts, whatever their label, are unlabelled. Numpy
logistic classifiers over word presence minimise the class-prior-corrected risk, whose negative part is kept
from going below zero; the weights of several folds' models are averaged. The threshold, which becomes the score 0.5, is set
without negatives too: on the rows that each fold's model has not seen, the one with the largest square of the positives' share
above it by the share of all rows above it. Only labels of rows with crc32(id as text) mod 5
other than 0 are learnt from, and only they give the class prior.

Bounds: the classifiers are fitted on at most MAX_POSITIVE positives and MAX_UNLABELLED unlabelled rows, the
ones of least hash, and on the VOCABULARY words that tell most. All rows and whole texts are scored.

Defined results: a null text counts as empty and scores like a text with none of the words; where no toxic row
may be learnt from, every score is 0; repeated rows are returned as often as given, and of repeated labels the
largest counts; a null identifier is not held out; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import least_hashed, materialize, release

MAX_POSITIVE, MAX_UNLABELLED, VOCABULARY = 4000, 8000, 1024
LEAST_ROWS, FOLDS, EPOCHS, BATCH, RATE, DECAY = 4, 4, 40, 512, 0.02, 1e-4
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> np.ndarray:
    """The weights (bias last) of one classifier: rows are 0/1 features; prior is that of the positive class.

    The risk is prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with the logistic loss; where the
    second part of a batch is below zero, the step undoes it instead.
    """
    rng = np.random.default_rng(seed)
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(u))
        for i in range(0, len(u), BATCH):
            bu, bp = u[order[i : i + BATCH]], p[rng.integers(0, len(p), BATCH)]
            zu, zp = bu @ w, bp @ w
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            slope = bu.T @ _sigmoid(zu) / len(bu) - prior * (bp.T @ _sigmoid(zp)) / len(bp)
            grad = -prior * (bp.T @ _sigmoid(-zp)) / len(bp) + slope if negative >= 0 else -slope
            grad = grad + DECAY * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """The vocabulary and the ensemble's weights (one row each); docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return {}, np.zeros((1, 1))
    prior = min(0.9, n_toxic / n_known)
    toxic = known.where("toxic = 1").select("doc_id")
    first = least_hashed(toxic.join(docs.select("doc_id"), "doc_id", "left_semi"), "doc_id", MAX_POSITIVE, n_toxic).withColumn("positive", F.lit(1))
    rest = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # repeated identifiers: the bound on the hash is the looser, by the number of distinct ones
    of = docs.agg(F.approx_count_distinct("doc_id")).first()[0] // 2
    rest = least_hashed(rest.distinct(), "doc_id", MAX_UNLABELLED, of).withColumn("positive", F.lit(0))
    chosen = materialize(first.unionByName(rest), "toxic-chosen")  # bounded, so it may be broadcast

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "positive": batch["positive"], "words": [list(set(_WORD.findall((t or "").lower()))) for t in batch["text"]]})

    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text").mapInPandas(words, "doc_id string, positive int, words array<string>")
    sample = materialize(sample, "toxic-sample")
    n_pos, n_all = sample.agg(F.sum("positive"), F.count(F.lit(1))).first()
    if not n_pos or n_pos == n_all:
        return {}, np.zeros((1, 1))
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS)
    rate_p, rate_u = (F.col("p") + 0.5) / (n_pos + 1), (F.col("n") - F.col("p") + 0.5) / (n_all - n_pos + 1)
    tells = F.abs(F.log(rate_p / rate_u)) * F.sqrt(F.greatest(rate_p, rate_u))
    top = [r["word"] for r in counts.orderBy(tells.desc(), "word").limit(VOCABULARY).collect()]
    vocabulary = {word: i for i, word in enumerate(top)}
    if not vocabulary:
        return {}, np.zeros((1, 1))

    held = sample.select("doc_id", "positive", F.array_intersect("words", F.lit(top)).alias("words")).collect()  # both bounds apply
    held.sort(key=lambda r: (r["doc_id"], r["positive"]))
    x = np.zeros((len(held), len(top)), np.float32)
    for i, row in enumerate(held):
        x[i, [vocabulary[w] for w in row["words"]]] = 1
    own = np.array([r["positive"] for r in held]) == 1
    fold = np.array([crc32(r["doc_id"].encode()) for r in held]) // 5 % FOLDS
    models, z = [], np.full(len(held), np.nan)
    for k in range(FOLDS):
        learn = fold != k
        if (own & learn).any() and (~own & learn).any():
            models.append(fit(x[own & learn], x[~own & learn], prior, k))
            z[~learn] = x[~learn] @ models[-1][:-1] + models[-1][-1]
    if not models:
        return {}, np.zeros((1, 1))
    weights = np.mean(models, axis=0)
    seen = ~np.isnan(z)
    weights[-1] -= threshold(z[seen & own], z[seen & ~own])
    return vocabulary, weights[None, :]


def threshold(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Where recall ** 2 / (share of all rows above) is largest: as high as precision times recall is, whatever the class prior."""
    if not len(positive) or not len(unlabelled):
        return 0.0
    every = np.unique(np.concatenate([positive, unlabelled]))
    middle = (every[1:] + every[:-1]) / 2
    recall = 1 - np.searchsorted(np.sort(positive), middle, "right") / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), middle, "right") / len(unlabelled)
    gain = recall**2 / np.maximum(above, 1 / len(unlabelled))
    return float(middle[gain.argmax()]) if len(middle) else 0.0


def score(text: Column, vocabulary: dict[str, int], weights: np.ndarray) -> Column:
    """The probability that the averaged weights give to each whole text."""
    if not vocabulary:
        return F.lit(0.0)
    keys = frozenset(vocabulary)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.empty(len(batch))
            for i, t in enumerate(batch):
                at = sorted(vocabulary[w] for w in keys.intersection(_WORD.findall((t or "").lower())))
                out[i] = _sigmoid(weights[:, at].sum(axis=1) + weights[:, -1]).mean()
            yield pd.Series(out)
        release()

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary, weights = train(docs, labels.select("doc_id", "toxic"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), vocabulary, weights).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
