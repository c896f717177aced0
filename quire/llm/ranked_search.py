"""Ranked lexical search over norm buckets of impact vectors (after LEMP).

A document is a vector with sqrt(w) * impact for each term, a query one with sqrt(w) for each of its terms, so that
their inner product is the score. Documents are ordered by length and cut into buckets of ``BUCKET`` vectors. Buckets
are searched from the longest vectors on, some at a time: once a query has its best so far, a bucket whose longest
vector cannot reach the last of them (Cauchy-Schwarz) is left out, and so is one whose largest coordinates cannot.
Inside a bucket the query's heaviest coordinates are summed first, and the rest of each vector is bounded by what is
left of its length and by the largest coordinates; what survives is scored exactly in 64-bit integers.

Queries are taken in blocks of bounded size; each block looks at the whole table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, python_ready, staged, table, with_row_id

BEST = 50
BUCKET = 1024
# Terms of the queries of a block, on average: bounds what is broadcast at a time.
BLOCK_TERMS = 1 << 17
# Shares of the buckets, longest vectors first, after which the thresholds of all tasks are brought together.
WAVES = (0.03, 0.25)
# Coordinates of a query that are summed before the rest is bounded.
FOCUS = 6
# Bounds are computed in doubles: what falls short by less than this share is kept.
SLACK = 1 - 1e-9

# Bytes that belong to terms, A-Z lower-cased; all others separate them.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = 2 ** 63 - 1


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text (UTF-8) in order, with repeats; null has none."""
    return (text or b"").translate(_FOLD).split()


def _item_terms(batches):
    for batch in batches:
        terms = [sorted(set(terms_of(x))) for x in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("query"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))],
            ["query", "item_id", "terms"])


class _Queries:
    """The queries of a block: their numbers, and the terms of each as places in the block's vocabulary."""

    def __init__(self, rows) -> None:
        self.numbers = np.array([r["query"] for r in rows], np.int64)
        words = sorted({bytes(t) for r in rows for t in r["terms"]})
        self.places = {word: i for i, word in enumerate(words)}
        self.terms = [np.array([self.places[bytes(t)] for t in r["terms"]], np.int64) for r in rows]


def _vectors(docs: DataFrame, asked) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the texts with terms: how often each holds the terms asked for; staged."""
    def counted(batches):
        places = asked.value.places
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                words = terms_of(body)
                if not words:
                    continue
                held = Counter(map(places.get, words))
                held.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(np.fromiter(held.keys(), np.int32, len(held)).tobytes())
                tfs.append(np.fromiter(held.values(), np.int32, len(held)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()),
                 pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    return staged(docs.mapInArrow(counted, "doc_id long, n long, terms binary, tfs binary"), "search-counts")


def _ints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _weights(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Texts with terms, terms with repeats, and the weight of each term asked for."""
    def held(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_ints(batch.column("terms")), minlength=size)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["term", "df"])

    total = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    found = counts.select("terms").mapInArrow(held, "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df")).collect()
    texts = total["docs"]
    df = np.zeros(size, np.int64)
    for row in found:
        df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    return texts, total["words"] or 0, weights


def _buckets(counts: DataFrame, texts: int, words: int, weights) -> DataFrame:
    """Buckets of impact vectors, longest first: the longest length, ids, lengths and the vectors by term; staged."""
    def measured(batches):
        weight = weights.value.astype(float)
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            held = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
            terms, tf = _ints(batch.column("terms")), _ints(batch.column("tfs")).astype(np.int64)
            m = np.repeat(np.array([50 + 50 * n * texts // words for n in sizes], np.int64), held)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m)
            owner = np.repeat(np.arange(len(sizes)), held)
            length = np.sqrt(np.bincount(owner, weight[terms] * impact.astype(float) ** 2, minlength=len(sizes)))
            cuts = np.cumsum(held)[:-1]
            impacts = [x.astype(np.int32).tobytes() for x in np.split(impact, cuts)] if len(sizes) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length), batch.column("terms"), pa.array(impacts, pa.binary())],
                ["doc_id", "length", "terms", "impacts"])

    def packed(batches):
        waiting, held = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                piece = batch.slice(start, BUCKET - held)
                start, held = start + piece.num_rows, held + piece.num_rows
                waiting.append(piece)
                if held == BUCKET:
                    yield _bucket(waiting)
                    waiting, held = [], 0
        if held:
            yield _bucket(waiting)

    measures = staged(counts.where(F.length("terms") > 0).mapInArrow(
        measured, "doc_id long, length double, terms binary, impacts binary"), "search-lengths")
    spread = F.xxhash64("doc_id", "terms")
    buckets = staged(measures.where("length > 0").repartitionByRange(F.desc("length"), spread).sortWithinPartitions(
        F.desc("length"), spread).mapInArrow(
        packed, "longest double, ids array<long>, lengths binary, starts binary, terms binary, at binary, impacts binary"),
        "search-buckets")
    discard(measures)
    return buckets


def _bucket(pieces) -> pa.RecordBatch:
    """One bucket: its entries ordered by term, so that a query reads the lists of its own terms only."""
    whole = pa.Table.from_batches(pieces).combine_chunks()
    held = [len(x) // 4 for x in whole["terms"].to_pylist()]
    terms, impacts = _ints(whole["terms"]), _ints(whole["impacts"])
    order = np.argsort(terms, kind="stable")
    at = np.repeat(np.arange(len(held), dtype=np.int32), held)[order]
    met, starts = np.unique(terms[order], return_index=True)
    lengths = whole["length"].to_numpy()
    blobs = (lengths, starts.astype(np.int32), met.astype(np.int32), at, impacts[order])
    return pa.RecordBatch.from_arrays(
        [pa.array([lengths.max()]), pa.array([whole["doc_id"].to_pylist()], pa.list_(pa.int64())),
         *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
        ["longest", "ids", "lengths", "starts", "terms", "at", "impacts"])


def survivors(terms: np.ndarray, weights: np.ndarray, bucket: dict, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the vectors of a bucket that coordinate bounds leave to a query.

    No vector with a score of ``least`` or more is left out.
    """
    lists = bucket["lists"][terms]
    met = lists >= 0
    lists, weight = lists[met], weights[terms[met]]
    tops = weight * bucket["tops"][lists]
    if tops.sum() < max(least, 1) * SLACK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heavy = np.argsort(-tops, kind="stable")
    score = np.zeros(bucket["n"], np.int64)
    squares = np.zeros(bucket["n"])
    starts, at, impacts = bucket["starts"], bucket["at"], bucket["impacts"]
    for i in heavy[:FOCUS]:
        a, b = starts[lists[i]], starts[lists[i] + 1]
        score[at[a:b]] += weight[i] * impacts[a:b]
        squares[at[a:b]] += weight[i] * impacts[a:b].astype(float) ** 2
    others = heavy[FOCUS:]
    rest = np.minimum(
        math.sqrt(weight[others].sum()) * np.sqrt(np.maximum(bucket["lengths"] ** 2 * (1 + 1e-9) - squares, 0)),
        float(tops[others].sum()))
    left = np.flatnonzero(score + rest >= max(least, 1) * SLACK)
    if len(left) and len(others):
        for i in others:
            a, b = starts[lists[i]], starts[lists[i] + 1]
            score[at[a:b]] += weight[i] * impacts[a:b]
    exact = score[left]
    good = exact >= max(least, 1)
    return left[good], exact[good]


def _search(buckets: DataFrame, asked, weights, bounds: np.ndarray, best: int) -> DataFrame:
    """``query, doc_id, score``: the best of each task's buckets that may be among a query's best; staged."""
    def found(batches):
        queries, weight = asked.value, weights.value
        norms = np.array([math.sqrt(weight[t].sum()) for t in queries.terms])
        bound = bounds.copy()
        lists = np.full(len(weight), -1, np.int64)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries.terms]
        for batch in batches:
            for i in range(batch.num_rows):
                longest = batch.column("longest")[i].as_py()
                active = np.flatnonzero(norms * longest >= np.maximum(bound, 1) * SLACK)
                if not len(active):
                    continue
                named = batch.column("ids")[i].values
                ids, empty = named.fill_null(_LAST).to_numpy(), named.is_null().to_numpy(zero_copy_only=False)
                read = {c: np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("starts", "terms", "at", "impacts")}
                impacts = read["impacts"].astype(np.int64)
                lists[read["terms"]] = np.arange(len(read["terms"]))
                bucket = {
                    "n": len(ids), "lists": lists, "at": read["at"], "impacts": impacts,
                    "starts": np.append(read["starts"], len(impacts)), "tops": np.maximum.reduceat(impacts, read["starts"]),
                    "lengths": np.frombuffer(batch.column("lengths")[i].as_py(), float)}
                for q in active:
                    left, score = survivors(queries.terms[q], weight, bucket, bound[q])
                    if not len(left):
                        continue
                    scores = np.append(held[q][0], score)
                    docs = np.append(held[q][1], ids[left])
                    nulls = np.append(held[q][2], empty[left])
                    order = np.lexsort((docs, nulls, -scores))[:best]
                    held[q] = scores[order], docs[order], nulls[order]
                    if len(order) == best:
                        bound[q] = max(bound[q], scores[order[-1]])
                lists[read["terms"]] = -1
        for q, (scores, docs, nulls) in enumerate(held):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), queries.numbers[q])), pa.array(docs, mask=nulls), pa.array(scores)],
                    ["query", "doc_id", "score"])

    return buckets.mapInArrow(found, "query long, doc_id long, score long")


def _top(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _ranked_block(spark, docs: DataFrame, rows, best: int) -> DataFrame | None:
    """``query, rank, doc_id, score`` for a block of queries, staged; none if no text holds a term."""
    queries = _Queries(rows)
    asked = spark.sparkContext.broadcast(queries)
    counts = _vectors(docs, asked)
    texts, words, known = _weights(counts, len(queries.places))
    if not words:
        return None
    weights = spark.sparkContext.broadcast(known)
    buckets = _buckets(counts, texts, words, weights)
    discard(counts)
    cuts = buckets.agg(F.percentile_approx("longest", [1 - w for w in WAVES], 10_000)).first()[0] or []
    bounds = np.zeros(len(queries.terms))
    place = {number: i for i, number in enumerate(queries.numbers.tolist())}
    top, above = None, None
    for cut in [*cuts, None]:
        wave = buckets if above is None else buckets.where(F.col("longest") < above)
        if cut is not None:
            wave = wave.where(F.col("longest") >= cut)
        found = _search(wave, asked, weights, bounds, best)
        better = staged(_top(found if top is None else found.unionByName(top.select("query", "doc_id", "score")), best),
                        "search-best")
        if top is not None:
            discard(top)
        top, above = better, cut
        for row in top.where(F.col("rank") == best).select("query", "score").collect():
            bounds[place[row["query"]]] = row["score"]
    discard(buckets)
    return top.select("query", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``best`` documents of each item with a score above 0: ``item_id, rank, doc_id, score``.

    Terms are runs of digits, A-Z, a-z and characters beyond ASCII in whole texts, A-Z lower-cased; null and empty
    texts have none and are never found, and items without terms have no rows. Equal scores are ordered by document id,
    null ids last; rows that repeat a document or an item each count for themselves (two items of one id: two
    rankings). Empty tables give no rows; other columns are not looked at.
    """
    spark = python_ready(docs)
    asked = staged(with_row_id(items.select(
        F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("body")), "query").select(
        "query", "item_id", "body").mapInArrow(
        _item_terms, f"query long, item_id {dict(items.dtypes)[item_id]}, terms array<binary>"), "search-items")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(terms / block_terms))
    parts = []
    for block in range(blocks):
        rows = asked.where(F.size("terms") > 0).where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        if rows and (part := _ranked_block(spark, slim, rows, best)) is not None:
            parts.append(part)
    names = asked.select("query", "item_id")
    if not parts:
        return names.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                           F.lit(0).cast("long").alias("score"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.join(names, "query").select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
totals AS (SELECT count(*) AS nd, sum(len(words))::BIGINT AS l FROM docs WHERE len(words) > 0),
tfs AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, nd),
scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(words) * nd) // l))))::BIGINT AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (r), totals GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
