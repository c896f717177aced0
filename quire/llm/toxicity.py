"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. Each n-gram's value is the log of how much more often toxic texts hold it
than others; a logistic regression over these values is fitted on labelled rows. Learning reads at most
``MOST_LABELLED`` labelled rows, chosen by a hash of their ids; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import (
    discard, kept_rows, numbered, python_ready, remainder, staged, table, unused_name, with_row_id,
)
from quire.llm.grams import all_distinct, distinct, sigmoid

ORDERS = (4, 5, 6)
BITS = 20
THRESHOLD = 0.7
# Documented bound of the training sample; its n-grams go to the driver only as counts of at most 2^20 buckets.
MOST_LABELLED = 40_000
LEAST_TEXTS = 3
LEAST_RATIO = 1.0
# Ratios within this many standard errors of zero are noise.
LEAST_ERRORS = 2.5
STEPS = 400
# n-grams of the sample that a step of the fit unpacks at a time.
PART = 1 << 18
RATE = 0.05
DECAY = 0.1


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``toxic, body`` of at most ``most`` labelled documents whose remainder modulo 3 is not 1.

    Labels without id or value are left out; of contradicting labels of one id the toxic one counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder(F.col("doc_id"), 3) != 1).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "body").join(F.broadcast(sample), "doc_id").select("toxic", "body")


def _counts(batches):
    """How many texts of each class hold each bucket: one row per bucket met in this partition."""
    totals = np.zeros((2, 1 << BITS), np.int64)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64) > 0
        for of in (0, 1):
            texts[of] += int((toxic == of).sum())
        for owner, bucket in distinct(batch.column("body").to_pylist(), ORDERS, BITS):
            for of in (0, 1):
                np.add.at(totals[of], bucket[toxic[owner] == of], 1)
    met = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(met, -1)), pa.array(np.append(totals[0][met], texts[0])),
         pa.array(np.append(totals[1][met], texts[1]))], ["bucket", "clean", "toxic"])


def log_count_ratios(counts: pd.DataFrame) -> np.ndarray:
    """For each bucket the log ratio of its share in toxic and in other texts; zero where it says little."""
    total = counts[counts["bucket"] == -1]
    clean, toxic = (float(total[c].sum()) for c in ("clean", "toxic"))
    rows = counts[counts["bucket"] >= 0]
    ratio = np.log((rows["toxic"] + 1) / (toxic + 2)) - np.log((rows["clean"] + 1) / (clean + 2))
    error = np.sqrt(1 / (rows["toxic"] + 1) + 1 / (rows["clean"] + 1))
    telling = (rows["toxic"] + rows["clean"] >= LEAST_TEXTS) & (
        np.abs(ratio) >= np.maximum(LEAST_RATIO, LEAST_ERRORS * error))
    ratios = np.zeros(1 << BITS)
    ratios[rows["bucket"][telling].to_numpy()] = ratio[telling].to_numpy()
    return ratios


def fit_logistic(parts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, ratios: np.ndarray,
                 ) -> tuple[np.ndarray, float]:
    """Weights per bucket, ratio included, and intercept: full-batch Adam on the logistic loss with decay.

    ``parts`` holds the rows in order, some at a time: how many buckets each has, and the buckets one after another
    (32-bit). Each step goes over the parts, so its own arrays are as large as one part, not as the sample. The list is
    used up: its buckets are replaced by their places among those met.
    """
    met = np.zeros(1 << BITS, bool)
    for _, buckets in parts:
        met[buckets] = True
    used = np.flatnonzero(met)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # In place: the sample is held once, not twice.
    for at, (sizes, buckets) in enumerate(parts):
        parts[at] = sizes, place[buckets]
    value = ratios[used]
    weight = np.full(len(used), 0.1)
    rate = toxic.mean()
    bias = float(np.log(rate / (1 - rate)))
    m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        v = weight * value
        slope = np.zeros(len(used))
        off, start = 0.0, 0
        for sizes, column in parts:
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            score = bias + np.bincount(owner, v[column], minlength=len(sizes))
            error = (sigmoid(score) - toxic[start:start + len(sizes)]) / len(toxic)
            slope += np.bincount(column, error[owner], minlength=len(used))
            off += error.sum()
            start += len(sizes)
        gradient = np.append(value * slope + DECAY * weight / len(toxic), off)
        m = 0.9 * m + 0.1 * gradient
        s = 0.999 * s + 0.001 * gradient ** 2
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-9)
        weight -= move[:-1]
        bias -= float(move[-1])
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = weight * value
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model: a weight per bucket and an intercept. Without rows of both classes it is their bare rate."""
    sample = labelled_texts(docs, labels)
    counts = sample.mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Buckets that fewer texts hold say nothing; what is left is bounded by the number of buckets.
    found = counts.where(f"bucket = -1 OR clean + toxic >= {LEAST_TEXTS}").toPandas()
    total = found[found["bucket"] == -1]
    toxic, clean = int(total["toxic"].sum()), int(total["clean"].sum())
    if not toxic or not clean:
        return np.zeros(1 << BITS, np.float32), 40.0 if toxic else -40.0
    ratios = log_count_ratios(found)
    del found
    wanted = docs.sparkSession.sparkContext.broadcast(ratios != 0)

    def telling(batches):
        for batch in batches:
            owner, bucket = all_distinct(batch.column("body").to_pylist(), ORDERS, BITS, wanted.value)
            lists = np.split(bucket, np.cumsum(np.bincount(owner, minlength=batch.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("toxic").to_pylist(), pa.int32()),
                 pa.array([x.astype(np.int32).tobytes() for x in lists], pa.binary())], ["toxic", "buckets"])

    # One partition at a time reaches the driver, and only packed 32-bit buckets stay.
    lists = staged(sample.mapInArrow(telling, "toxic int, buckets binary"), "toxic-sample")
    parts, marks, waiting, held = [], [], [], 0
    for row in lists.toLocalIterator():
        marks.append(row["toxic"] > 0)
        waiting.append(np.frombuffer(row["buckets"], np.int32))
        held += len(waiting[-1])
        if held >= PART:
            parts.append(_part(waiting))
            waiting, held = [], 0
    if waiting:
        parts.append(_part(waiting))
    discard(lists)
    return fit_logistic(parts, np.array(marks, float), ratios)


def _part(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(r) for r in rows], np.int64), np.concatenate(rows)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          row_id: str | None = None) -> DataFrame:
    """One row per input row: ``row_id, doc_id, held_out, score, predicted``.

    The score is the probability of a toxic text (0 to 1), predicted is 1 from ``THRESHOLD`` on. Null and empty texts
    have no n-grams and get the intercept's score; null ids are held out or not as the empty text is, and never
    matched to a label; repeated rows have equal scores; an empty table gives no rows; other columns are not looked
    at. Without labelled texts of both classes every row gets the class there is, or 0.
    """
    spark = python_ready(docs)
    docs = docs if row_id else with_row_id(docs, row_id := unused_name(docs, "row_id"))
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
                           F.col(text).cast("string").alias("body"))
    weights, bias = fit(rows, labels)
    model = spark.sparkContext.broadcast((weights, weights != 0))

    def scores(batches):
        weight, telling = model.value
        for batch in batches:
            owner, bucket = all_distinct(batch.column("body").to_pylist(), ORDERS, BITS, telling)
            total = bias + np.bincount(owner, weight[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(sigmoid(total), pa.float64())],
                ["row_id", "doc_id", "score"])

    return rows.mapInArrow(scores, f"row_id {dict(rows.dtypes)['row_id']}, doc_id long, score double").select(
        "row_id", "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns.

    Rows with null or empty texts, null ids and repeated rows are each judged by their text; an empty table stays empty;
    columns may have any names. Rows are known by an identity that
    holds for all jobs (``numbered``).
    """
    name = unused_name(docs, "row_id")
    rows = numbered(docs, name)
    stay = score(rows, labels, row_id=name).where("predicted = 0").select(F.col("row_id").alias(name))
    return kept_rows(rows, stay, name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted")
