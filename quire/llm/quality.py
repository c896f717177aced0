"""Document quality from weak labels.

Overlapping heuristics each fire or stay silent on every document. Expectation-maximisation over the counts of their
firing patterns (at most 2^11, whatever the rows) estimates how often each fires on good and on bad documents, without
any label; the posterior of each pattern is a soft label. A hashed linear scorer learns those labels from a bounded
sample and scores all texts.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import python_ready, table
from quire.llm.grams import hashed, sigmoid

BITS = 16
# Buckets of character trigrams; the bins of the measures lie above them.
TRIGRAMS = 1 << (BITS - 1)
# Documented bound of the scorer's training sample: documents by the hash of their ids. The hash is set to keep five
# sixths of it, so that the bound itself cuts only where very many rows share one id.
MOST_TRAINED = 20_000
THRESHOLD = 0.5
ROUNDS = 200
EPOCHS = 20
STEP_DOCUMENTS = 500
RATE = 0.02
DECAY = 1e-4

_MARKS = b"#$%&*|<>{}=^~!"
_UPPER = bytes(range(65, 91))
# What is left without these: ASCII letters and the first bytes of other characters.
_NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0))
_MEASURES = ("words", "marks", "upper", "letters", "distinct", "common", "per_end", "length")
# Heuristics in the order of the pattern; the last two speak for a document, the others against it.
HEURISTICS = ("symbols", "few letters", "shouting", "exclamation", "table bars", "repetition", "echoes", "one word",
              "no sentences",
              "plain prose", "usual words")


def measures(text: str) -> tuple[float, ...]:
    """What the heuristics look at, in the order of ``_MEASURES``; bars, exclamation marks and echoes per word follow."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    letters = len(raw.translate(None, _NO_LETTERS))
    shown = sum(map(len, words))
    ends = raw.count(b". ") + raw.count(b".\n") + raw.count(b"? ") + raw.count(b"! ") + raw.endswith(b".")
    least = max(n, 1)
    return (n, (len(raw) - len(raw.translate(None, _MARKS))) / least,
            (len(raw) - len(raw.translate(None, _UPPER))) / max(letters, 1), letters / max(shown, 1), len(counts) / least,
            max(counts.values(), default=0) / least, n / max(ends, 1), letters / least,
            raw.count(b"|") / least, raw.count(b"!") / least, sum(map(eq, words, words[1:])) / least)


def fired(m: tuple[float, ...]) -> str:
    """One digit per heuristic: 1 where it fires."""
    n, marks, upper, letters, distinct, common, per_end, length, bars, shouts, echoes = m
    # A longer text repeats its words more; the floor falls with the square root of its length.
    floor = min(0.25, 2 / max(n, 1) ** 0.5)
    against = (marks > 0.3, n >= 10 and letters < 0.7, upper > 0.4 and n > 3, shouts > 0.3, bars > 0.1, n >= 30 and distinct < floor,
               n >= 10 and echoes > 0.3,
               n >= 30 and common > 0.2, n >= 30 and per_end > 100)
    prose = n > 0 and echoes < 0.3 and marks < 0.1 and upper < 0.3 and letters >= 0.75 and (n < 30 or distinct > floor and common < 0.15)
    return "".join("1" if x else "0" for x in (*against, prose, 2 <= length <= 12 and letters >= 0.7))


def expectation_maximisation(patterns: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" per pattern, firing rates (truth x heuristic), share of good documents.

    Heuristics fire independently given the truth. They start at four in five for the class they speak for and one in
    twenty for the other, which also fixes which class is the good one.
    """
    fires = np.array([[c == "1" for c in p] for p in patterns], float)
    counts = counts.astype(float)
    for_good = np.arange(len(HEURISTICS)) >= len(HEURISTICS) - 2
    rate = np.stack([np.where(for_good, 0.1, 0.4), np.where(for_good, 0.9, 0.02)])
    share = 0.85
    for _ in range(ROUNDS):
        log = [fires @ np.log(rate[t]) + (1 - fires) @ np.log(1 - rate[t]) for t in (0, 1)]
        good = sigmoid(log[1] - log[0] + np.log(share / (1 - share)))
        for truth, weight in ((0, counts * (1 - good)), (1, counts * good)):
            rate[truth] = np.clip((weight @ fires + 0.1) / (weight.sum() + 0.2), 1e-3, 1 - 1e-3)
        share = float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99))
    return good, rate, share


def measure_buckets(measured: list[tuple[float, ...]]) -> np.ndarray:
    """Texts x measures: the bucket of the bin each measure falls into."""
    m = np.array([x[:len(_MEASURES)] for x in measured], float).reshape(len(measured), len(_MEASURES))
    share = np.isin(_MEASURES, ("marks", "upper", "letters", "distinct", "common"))
    step = np.minimum(np.where(share, m * 20, np.log2(1 + m) * 2), 31).astype(np.int64)
    return TRIGRAMS + np.arange(len(_MEASURES)) * 64 + step


def features(text: str, measured: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text: ten times the shares of its character trigrams, one for each measure's bin."""
    counts = np.zeros(TRIGRAMS)
    for _, bucket in hashed([text], (3,), BITS - 1, raw=True):
        counts += np.bincount(bucket, minlength=TRIGRAMS)
    met = np.flatnonzero(counts)
    return (np.append(met, measure_buckets([measured])[0]).astype(np.int32),
            np.append(counts[met] * (10 / max(counts.sum(), 1)), np.ones(len(_MEASURES))).astype(np.float32))


def weighed(texts: list[str], measured: list[tuple[float, ...]], weight: np.ndarray) -> np.ndarray:
    """Sum of weight times value over the features of each text, some characters at a time."""
    total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for owner, bucket in hashed(texts, (3,), BITS - 1, raw=True):
        total += np.bincount(owner, weight[bucket], minlength=len(texts))
        size += np.bincount(owner, minlength=len(texts))
    return total * (10 / np.maximum(size, 1)) + weight[measure_buckets(measured)].sum(axis=1)


def _pattern_rows(batches):
    for batch in batches:
        found = [fired(measures(t or "")) for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "votes"])


def _sampled(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("body").to_pylist()]
        measured = list(map(measures, texts))
        made = [features(t, m) for t, m in zip(texts, measured)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), pa.array(map(fired, measured), pa.string()),
             pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))],
            ["place", "votes", "buckets", "values"])


def fit_scorer(drawn: pa.Table, soft: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per bucket and intercept for soft labels: Adam on the logistic loss with decay, some documents a step.

    ``drawn`` has one row per document: its ``buckets`` and their ``values``. Only one step's documents are unpacked.
    """
    weight = np.zeros((1 << BITS) + 1, np.float32)
    m, s = np.zeros_like(weight), np.zeros_like(weight)
    step = 0
    for _ in range(EPOCHS):
        for start in range(0, drawn.num_rows, STEP_DOCUMENTS):
            lists = [drawn[c].slice(start, STEP_DOCUMENTS).combine_chunks() for c in ("buckets", "values")]
            bucket, value = (x.flatten().to_numpy() for x in lists)
            wanted = soft[start:start + STEP_DOCUMENTS]
            owner = np.repeat(np.arange(len(wanted)), lists[0].value_lengths().to_numpy())
            made = np.bincount(owner, value * weight[bucket], minlength=len(wanted))
            error = (sigmoid(weight[-1] + made) - wanted) / len(wanted)
            gradient = DECAY * weight
            gradient[:-1] += np.bincount(bucket, value * error[owner], minlength=1 << BITS)
            gradient[-1] = error.sum()
            step += 1
            m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient ** 2
            weight -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-9)
    return weight[:-1], float(weight[-1])


def _edge(share: float) -> int:
    """The largest 64-bit hash in the given share of all, which starts at the least one."""
    return min(int(share * (1 << 64)), 1 << 64) - (1 << 63) - 1


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, votes, posterior, score, predicted`` (1: good).

    ``posterior`` is the label model's, ``score`` the scorer's probability of a good document (0 to 1), from which
    ``predicted`` follows. Null and empty texts count as texts without words; null ids stay null; repeated rows have
    equal results; an empty table gives no rows; other columns are not looked at.
    """
    spark = python_ready(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    counted = rows.mapInArrow(_pattern_rows, "doc_id long, votes string").groupBy("votes").agg(
        F.count(F.lit(1)).alias("n")).toPandas()
    if counted.empty:
        counted = pd.DataFrame({"votes": ["0" * len(HEURISTICS)], "n": [1]})
    good, _, _ = expectation_maximisation(counted["votes"].tolist(), counted["n"].to_numpy())
    posterior = dict(zip(counted["votes"], good.tolist()))

    place = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)))
    share = min(1.0, MOST_TRAINED / 1.2 / max(int(counted["n"].sum()), 1))
    sample = rows.where(place <= _edge(share)).select("body", place.alias("place"))
    drawn = sample.mapInArrow(_sampled, "place long, votes string, buckets array<int>, values array<float>").limit(
        MOST_TRAINED).toArrow().sort_by("place")
    soft = np.array([posterior[v] for v in drawn["votes"].to_pylist()])
    model = fit_scorer(drawn, soft)
    shared = spark.sparkContext.broadcast((posterior, *model))

    def scores(batches):
        posterior, weight, bias = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("body").to_pylist()]
            measured = list(map(measures, texts))
            cast = list(map(fired, measured))
            made = bias + weighed(texts, measured, weight)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cast, pa.string()),
                 pa.array([posterior[v] for v in cast], pa.float64()), pa.array(sigmoid(made), pa.float64())],
                ["doc_id", "votes", "posterior", "score"])

    return rows.mapInArrow(scores, "doc_id long, votes string, posterior double, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
