"""Language ID in two levels: the family first, then one-versus-one linear SVMs within it.

Features are hashed character 1- to 3-grams (square roots of counts, scaled to length 1). At either
level every pair of classes has a linear SVM; the class with most votes wins, ties by the sum of
margins, then by name. Languages without an entry in FAMILIES share the family "other". Fitted on
about `SAMPLE` documents of each language (a documented bound, taken by hash of doc_id).

The score is the product over both levels of the winner's weakest pairwise probability (a sigmoid
of the margin).

Defined cases: a null text or one without a letter is `und` with score 0; so is everything if no
row can teach; a single language needs no SVM and has score 1; ties of votes and margins go to the
language first in order; repeated rows get equal predictions; very long texts are read whole, a
stretch at a time; an empty table gives no rows; columns of the new names are replaced, other
columns are left alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .ngrams import buckets, sigmoid
from .shared import bound_batches, materialise, no_nulls

ORDERS, BITS = (1, 3), 10
#: Documents of each language to learn from, on average.
SAMPLE = 1_500
# Families of common languages.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sk": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
    "hi": "indic", "bn": "indic", "ur": "indic", "mr": "indic", "zh": "sinitic", "ja": "japonic", "ko": "koreanic", "ar": "semitic", "he": "semitic", "am": "semitic",
}
LETTER = regex.compile(r"\p{L}")


def vector(text: str) -> np.ndarray:
    x = np.zeros(1 << BITS)
    for b in buckets(text, ORDERS, BITS):
        x += np.bincount(b, minlength=1 << BITS)
    np.sqrt(x, out=x)
    return x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Level:
    """One-versus-one: classes, the pairs of their numbers, a weight column and an intercept for each pair."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    intercepts: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the number of the class, and its weakest pairwise probability."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.weights + self.intercepts  # over 0: the first of the pair
        votes, total, weakest = np.zeros((n, k)), np.zeros((n, k)), np.ones((n, k))
        for c, (a, b) in enumerate(self.pairs):
            m = margins[:, c]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            total[:, a] += m
            total[:, b] -= m
            weakest[:, a] = np.minimum(weakest[:, a], sigmoid(4 * m))
            weakest[:, b] = np.minimum(weakest[:, b], sigmoid(-4 * m))
        best = np.argmax(votes + 1e-6 * np.tanh(total), axis=1)
        return best, weakest[np.arange(n), best]


@dataclass
class Model:
    families: Level | None
    within: dict[str, Level]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if LETTER.search(t)]
        if some and self.families is not None:
            x = np.stack([vector(texts[i]) for i in some])
            family, sure = self.families.predict(x)
            for f in np.unique(family):
                own = np.flatnonzero(family == f)
                level = self.within[self.families.classes[f]]
                best, p = level.predict(x[own])
                at = np.array(some)[own]
                lang[at] = np.array(level.classes, object)[best]
                score[at] = sure[own] * p
        return lang.tolist(), score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [vector(t) for t in no_nulls(batch.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "x"])


def _level(train: DataFrame, by: str, classes: list[str]) -> Level:
    out = Level(classes)
    for a, b in combinations(range(len(classes)), 2):
        pair = train.where(F.col(by).isin(classes[a], classes[b])).select("features", (F.col(by) == classes[a]).cast("double").alias("label"))
        svm = LinearSVC(maxIter=40, regParam=1e-3, standardization=False).fit(pair)
        out.pairs.append((a, b))
        w = svm.coefficients.toArray()[:, None]
        out.weights = w if out.weights is None else np.hstack([out.weights, w])
        out.intercepts = np.append([] if out.intercepts is None else out.intercepts, svm.intercept)
    return out


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows of docs that have a text and a language."""
    bound_batches(docs.sparkSession)
    able = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model(None, {})
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
    some = able.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < share * 1_000_003)
    x = materialise(some.select("text", "lang").mapInArrow(_vectors, "lang string, x array<double>"), "language-vectors")
    kept = sorted(r[0] for r in x.select("lang").distinct().collect())
    family_of = {k: FAMILIES.get(k.lower().split("-")[0], "other") for k in kept}
    family = F.lit("other")
    for k, v in family_of.items():
        family = F.when(F.col("lang") == k, F.lit(v)).otherwise(family)
    train = x.select("lang", family.alias("family"), array_to_vector("x").alias("features")).coalesce(12).persist()
    try:
        families = _level(train, "family", sorted(set(family_of.values())))
        within = {f: _level(train, "lang", [k for k in kept if family_of[k] == f]) for f in families.classes}
    finally:
        train.unpersist()
    return Model(families, within)


LEAST_SCORE = 0.3


def accepted(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = LEAST_SCORE, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose predicted language is wanted (None: any that can be learned) with at least this score.

    The model learns from docs itself. A row without lang gets the predicted one; all other values stay. Rows whose
    text is null or without a letter go; if nothing can teach, these are all that go."""
    model = fitted(docs, text=text, lang=lang)
    names = ("__mp_lang", "__mp_score")
    seen = predicted(docs, model, text, names)
    if model.families is None:
        return seen.where(F.col(text).rlike(r"\p{L}")).select(*docs.columns)
    sure = (F.col(names[0]) != "und") & (F.col(names[1]) >= least)
    if languages is not None:
        sure = sure & F.col(names[0]).isin(*languages)
    return seen.where(sure).withColumn(lang, F.coalesce(F.col(lang), F.col(names[0]))).select(*docs.columns)


def _predicted(batches: Iterator[pa.RecordBatch], text: str, model: Model, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score = model.predict(no_nulls(batch.column(text)).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])


def predicted(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, in columns of these names."""
    bound_batches(docs.sparkSession)
    new = [StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    schema = StructType([*(f for f in docs.schema.fields if f.name not in names), *new])
    return docs.drop(*names).mapInArrow(lambda b: _predicted(b, text, model, names), schema)
