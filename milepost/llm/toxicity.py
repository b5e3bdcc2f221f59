"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Fitted on at most `SAMPLE` labelled rows (a documented bound, taken by hash of doc_id). Over these,
Spark counts for each hashed 3- to 6-gram how many documents of either class hold it; the log ratio
r of the smoothed class frequencies scales the feature. Every n-gram whose ratio is at least `LEAST_Z`
standard errors from chance goes into a logistic regression on x * r, as a sparse vector; its
boundary is moved halfway to where it lies as many deviations from either class. Every whole text is then scored in one pass, very long ones a stretch at a time.

Defined cases: null and empty texts hold no n-gram of a word and get the intercept's score; without
both classes among the labels every score is 0; conflicting labels of a doc_id: toxic wins; null
labels and doc_ids teach nothing; repeated rows get equal scores; an empty table gives none; a column
`score` of the input is replaced, other columns are left alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ngrams import buckets, sigmoid
from .shared import bound_batches, materialise, no_nulls

ORDERS, BITS = (3, 6), 20
SAMPLE, LEAST_DOCS, LEAST_Z = 12_000, 3, 2.5


@dataclass
class Model:
    """slot: for each bucket the number of its feature or -1; weights: of the features, ratio included."""

    slot: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        held = [s[s >= 0] for s in (self.slot[b] for b in buckets(text, ORDERS, BITS))] or [np.zeros(0, self.slot.dtype)]
        return float(sigmoid(self.weights[np.unique(np.concatenate(held))].sum() + self.intercept))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the documents of one task: in how many of either class each bucket is."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for t, y in zip(no_nulls(batch.column("text")).to_pylist(), batch.column("label").to_pylist()):
            counts[y, np.unique(np.concatenate(list(buckets(t, ORDERS, BITS)) or [np.zeros(0, np.uint32)]))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[1, part], pa.int64()), pa.array(counts[0, part], pa.int64())], names=["bucket", "pos", "neg"])


def _features(batches: Iterator[pa.RecordBatch], slot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The features that each text holds, by number."""
    for batch in batches:
        rows = []
        for t in no_nulls(batch.column("text")).to_pylist():
            held = [s[s >= 0] for s in (slot[b] for b in buckets(t, ORDERS, BITS))]
            rows.append(np.unique(np.concatenate(held)).astype(str).tolist() if held else [])
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), pa.array(rows, pa.list_(pa.string()))], names=["label", "held"])


def fitted(labelled: DataFrame) -> Model:
    """labelled: text and label (0 or 1), at most SAMPLE rows."""
    labelled = materialise(labelled.repartition(24), "toxic-sample")
    total = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    slot = np.full(1 << BITS, -1, np.int32)
    if set(total) != {0, 1}:
        return Model(slot, np.zeros(0), 0.0)
    counts = (labelled.mapInArrow(_counted, "bucket int, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST_DOCS))
    p, q = F.col("pos") + F.lit(1.0), F.col("neg") + F.lit(1.0)
    ratio = F.log(p / (total[1] + 2.0)) - F.log(q / (total[0] + 2.0))
    top = counts.select("bucket", ratio.alias("r"), F.abs(ratio / F.sqrt(1 / p + 1 / q)).alias("z")).where(F.col("z") >= LEAST_Z).select("bucket", "r").orderBy("bucket").collect()  # 2**BITS rows at most
    if not top:
        return Model(slot, np.zeros(0), 0.0)
    r = np.array([x["r"] for x in top])
    slot[[x["bucket"] for x in top]] = np.arange(len(top))
    train = materialise(labelled.mapInArrow(lambda b: _features(b, slot), "label double, held array<string>"), "toxic-features")
    rarity = max(1.0, (total[0] / total[1]) ** 0.5)  # the rarer class counts for more
    present = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(top))], inputCol="held", outputCol="present").setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(r), inputCol="present", outputCol="features")
    x = scaled.transform(present.transform(train)).select("label", F.when(F.col("label") == 1, F.lit(rarity)).otherwise(1.0).alias("weight"), "features")
    lr = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.0, standardization=False, weightCol="weight").fit(x)
    return Model(slot, lr.coefficients.toArray() * r, float(lr.intercept) - 0.5 * _middle(lr.transform(x)))


def _middle(fit: DataFrame) -> float:
    """The margin as many deviations above the clean rows' mean as below the toxic ones': clean margins lie close
    together, toxic ones spread with how much of a text is toxic."""
    margin = vector_to_array("rawPrediction")[1]
    of = {r["label"]: r for r in fit.groupBy("label").agg(F.avg(margin).alias("mean"), F.stddev_pop(margin).alias("dev")).collect()}
    low, high = of[0.0], of[1.0]
    both = low["dev"] + high["dev"]
    return low["mean"] + (high["mean"] - low["mean"]) * (low["dev"] / both if both else 0.5)


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """text and label of at most SAMPLE labelled documents, by hash of doc_id."""
    some = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    one = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    return one.join(F.broadcast(some), "_id").select("text", "label")  # SAMPLE rows of 12 bytes at most


def _scored(batches: Iterator[pa.RecordBatch], text: str, model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.score(t) for t in no_nulls(batch.column(text)).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the column score, 0 to 1."""
    bound_batches(docs.sparkSession)
    schema = StructType([*(f for f in docs.schema.fields if f.name != "score"), StructField("score", DoubleType())])
    return docs.drop("score").mapInArrow(lambda b: _scored(b, text, model), schema)
