"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every training text is counted; the counts per language and bucket are summed by Spark, smoothed into one matrix of
log probabilities (languages x 2^16, so 256 KB a language: bounded by how many
languages the table names) and broadcast. Texts are scored in batches by adding the rows of
that matrix that their n-grams point to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import python_ready, remainder, table
from quire.llm.grams import hashed

ORDERS = (1, 2, 3, 4)
BITS = 16
SMOOTHING = 0.5
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def model_of(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log probabilities (buckets x languages) and log priors, from ``lang, body``.

    Languages are the distinct non-null values; their number does not grow with the rows.
    """
    python_ready(rows)
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(texts)
    if not names:
        return [], np.zeros((1 << BITS, 0)), np.zeros(0)
    place = {n: i for i, n in enumerate(names)}

    def counts(batches):
        total = np.zeros(len(names) << BITS, np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for owner, bucket in hashed(batch.column("body").to_pylist(), ORDERS, BITS):
                total += np.bincount((lang[owner] << BITS) | bucket, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["cell", "n"])

    summed = rows.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full(len(names) << BITS, SMOOTHING)
    matrix[summed["cell"].to_numpy()] += summed["n"].to_numpy()
    matrix = matrix.reshape(len(names), 1 << BITS)
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    prior = np.array([texts[n] for n in names], float)
    return names, np.ascontiguousarray(matrix.T, np.float32), np.log(prior / prior.sum())


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Learns from the rows with a language whose id's remainder modulo 3 is not 1. The score is the posterior of the
    predicted language. Null texts and texts without a letter get ``und`` and 0, as do all texts when nothing was
    learned; ties go to the first language by name. Null ids are held out or not as the empty text is; repeated rows
    have equal results; an empty table gives no rows; other columns are not looked at.
    """
    spark = python_ready(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"),
                       F.col(lang).cast("string").alias("lang"))
    names, matrix, prior = model_of(rows.where("lang IS NOT NULL AND body IS NOT NULL").where(
        remainder(F.col("doc_id"), 3) != 1).select("lang", "body"))
    shared = spark.sparkContext.broadcast((matrix, prior))

    def predictions(batches):
        matrix, prior = shared.value
        for batch in batches:
            texts = batch.column("body").to_pylist()
            total = np.tile(prior, (len(texts), 1))
            lettered = np.zeros(len(texts), bool)
            for owner, bucket in hashed(texts, ORDERS, BITS):
                for j in range(len(names)):
                    total[:, j] += np.bincount(owner, matrix[bucket, j], minlength=len(texts))
            for i, t in enumerate(texts):
                lettered[i] = has_letter(t)
            if names:
                best = total.argmax(axis=1)
                chance = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
            else:
                best, chance = np.zeros(len(texts), int), np.zeros(len(texts))
            known = lettered & bool(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, chance, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    found = rows.select("doc_id", "body").mapInArrow(predictions, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
