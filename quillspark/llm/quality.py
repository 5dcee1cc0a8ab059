"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view has a logistic classifier fitted on the labelled rows. Over ROUNDS, each labels the unlabelled rows
that it is surest of, and the other view learns from them. Both views' outputs are then calibrated on the
labelled rows (by cross-fitting halves), and the calibrated log odds combined.

Bounds: at most MAX_LABELLED labelled and MAX_UNLABELLED other rows, those of least hash, are learnt from; all
rows and whole texts are scored.

Defined results: a null text counts as empty, a null language or source as its own value, a null length as 0;
where the labels lack one of the two classes, every score is 1 and every row is kept; repeated rows are returned
as often as given, and of repeated labels the least counts; columns named quality_score or quality_kept are replaced;
an empty table gives no rows.
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

MAX_LABELLED, MAX_UNLABELLED = 10_000, 10_000
ROUNDS, TAUGHT, SURE = 5, 400, 0.9
#: A row is rejected when its chance of being good is below this: clean rows are to stay.
KEEP_FROM = 0.3
_WORD = re.compile(r"\w+")
_ODD = re.compile(r"[^\w\s.,;:'()-]")
SOURCES = 16


def content_view(text: str) -> list[float]:
    """What the text itself shows: case, symbols, repetition, word shapes, layout."""
    n = max(1, len(text))
    words = _WORD.findall(text)
    every = text.split("\n")
    lines = [x for x in every if x.strip()]
    odd = _ODD.findall(text)
    k = max(1, len(words))
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, words))
    shape = [upper / k, len(odd) / n, len(odd) / k, text.count("!") / k, sum(map(str.isdigit, words)) / k, letters / k, len(set(words)) / k, len(set(lines)) / max(1, len(lines)), k / n, float(not words)]
    return [*shape, np.log1p(len(every)), n / len(every) / 100, max(map(len, every)) / n]


def metadata_view(lang: str | None, source: str | None, n_chars: float) -> list[float]:
    """What stands beside the text, which is not looked at: its recorded length, language and source."""
    langs, sources = [0.0] * 8, [0.0] * SOURCES
    langs[crc32((lang or "").encode()) % 8] = 1.0
    sources[crc32((source or "").encode()) % SOURCES] = 1.0
    return [np.log1p(max(0.0, n_chars)), *langs, *sources]


def views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    texts = ["" if t is None else t for t in text]
    content = np.array([content_view(t) for t in texts], float).reshape(len(texts), -1)
    beside = [metadata_view(lang_, source_, 0.0 if pd.isna(n) else float(n)) for lang_, source_, n in zip(lang, source, n_chars)]
    return content, np.array(beside, float).reshape(len(texts), -1)


class Logistic:
    """Logistic regression over standardised features and their squares, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z, s = self._grown(x), np.ones(len(y)) if weight is None else weight
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 1.0)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = self._p(z)
            step = np.linalg.solve((z * (s * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (s * (y - p)) - ridge * self.w)
            self.w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _grown(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([z, z**2, np.ones((len(z), 1))])

    def _p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -35, 35)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._p(self._grown(x))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, unlabelled: tuple[np.ndarray, np.ndarray]) -> tuple[list[Logistic], Logistic]:
    """Both views' classifiers and the one that combines their log odds."""

    def taught(own: tuple[np.ndarray, np.ndarray], y_: np.ndarray) -> list[Logistic]:
        extra: list[list] = [[np.empty(0, int), np.empty(0)], [np.empty(0, int), np.empty(0)]]
        for _ in range(ROUNDS):
            models = []
            for v in (0, 1):
                at, said = extra[v]
                weight = np.concatenate([np.ones(len(y_)), np.full(len(at), 0.25)])
                models.append(Logistic().fit(np.vstack([own[v], unlabelled[v][at]]), np.concatenate([y_, said]), weight))
            if not len(unlabelled[0]):
                break
            for v in (0, 1):
                p = models[v].predict(unlabelled[v])
                good, bad = np.argsort(-p, kind="stable")[:TAUGHT], np.argsort(p, kind="stable")[:TAUGHT]
                good, bad = good[p[good] >= SURE], bad[p[bad] <= 1 - SURE]
                extra[1 - v] = [np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])]
        return models

    half = np.arange(len(y)) % 2 == 0
    z = np.zeros((len(y), 2))
    for part in (half, ~half):
        if 0 < y[part].sum() < part.sum():
            for v, model in enumerate(taught((labelled[0][part], labelled[1][part]), y[part])):
                z[~part, v] = _odds(model.predict(labelled[v][~part]))
    return taught(labelled, y), Logistic().fit(z, y)


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[Logistic], Logistic] | None:
    """The models, from docs (documents' columns) and labels (doc_id, quality); None where a class is missing."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n_known = known.count()
    some = least_hashed(known, "doc_id", MAX_LABELLED, n_known)
    ids = docs.select("doc_id").where("doc_id is not null")
    # the bound on the hash comes before the join; it is the looser, by the labelled rows and by repeated identifiers
    of = max(0, docs.agg(F.approx_count_distinct("doc_id")).first()[0] // 2 - n_known)
    rest = least_hashed(ids.join(known, "doc_id", "left_anti").distinct(), "doc_id", MAX_UNLABELLED, of).withColumn("quality", F.lit(None).cast("int"))
    chosen = materialize(some.unionByName(rest.select("doc_id", F.col("quality").cast(some.schema["quality"].dataType))), "quality-chosen")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = views(batch["text"], batch["lang"], batch["source"], batch["n_chars"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "a": list(a), "b": list(b)})

    sample = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("double"), "text", "lang", "source", "n_chars")
    rows = sample.mapInPandas(run, "doc_id long, quality double, a array<double>, b array<double>").toPandas()  # both bounds apply
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    own = rows["quality"].notna().to_numpy()
    y = rows.loc[own, "quality"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    a, b = np.stack(rows["a"]), np.stack(rows["b"])
    return co_train((a[own], b[own]), y, (a[~own], b[~own]))


def score(models: tuple[list[Logistic], Logistic] | None, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """The chance that a row is good."""
    if models is None:
        return F.lit(1.0)
    (first, second), both = models

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text_, lang_, source_, n_chars_ in batches:
            a, b = views(text_, lang_, source_, n_chars_)
            z = np.stack([_odds(first.predict(a)), _odds(second.predict(b))], axis=1) if len(a) else np.empty((0, 2))
            yield pd.Series(both.predict(z) if len(a) else np.empty(0))
        release()

    return run(text, lang, source, n_chars)


def quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs' rows with the columns quality_score and quality_kept after those of docs."""
    models = train(docs, labels.select("doc_id", "quality"))
    scored = docs.withColumn("quality_score", score(models, F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double")))
    return scored.withColumn("quality_kept", F.col("quality_score") >= keep_from)
