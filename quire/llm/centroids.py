"""Centroid clustering over zone maps of Hilbert-ordered vectors.

Vectors are turned into integers, ordered along a Hilbert curve and packed into blocks of ``BLOCK`` neighbours, each
with the smallest and largest value of every component (its box) and its componentwise sum. In a round the distance
bounds between box and centroids leave a block its candidate centroids: one that is farther than another from every
point of the box cannot win. A block with one candidate gives its sums without its vectors being looked at, any
other compares all its vectors with its candidates exactly, in 64-bit integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, python_ready, staged, table

COMPONENTS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SALT = "1"
BLOCK = 512
# Bits of a component in the key of the curve; its cells lie between two deviations below and above the mean.
BITS = 3
# Scaled components stay below this: squared distances then fit 64 bits.
LIMIT = 1 << 27

_BLOCKS = "n int, ids array<long>, cells binary, lo binary, hi binary, total binary"


def _usable(batches):
    """Ids and scaled integers of the vectors that are kept."""
    for batch in batches:
        sized = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), COMPONENTS), False)
        some = batch.filter(sized)
        values = some.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
        cells = np.floor(values * float(SCALE))
        good = np.isfinite(values).all(axis=1) & (np.abs(cells) < LIMIT).all(axis=1)
        rows = [row.tobytes() for row in cells[good].astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [some.column("vec_id").filter(pa.array(good)), pa.array(rows, pa.binary())], ["vec_id", "cells"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, COMPONENTS)


def hilbert_keys(grid: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of rows of small integers (below ``2 ** bits``), as sortable bytes.

    The transform of axes to the transposed index is Skilling's (2004), applied to all rows at once.
    """
    x = grid.T.astype(np.int64)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, component, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _moments(batches):
    """Number, sum and sum of squares of each component in a partition."""
    n, total, squares = 0, np.zeros(COMPONENTS), np.zeros(COMPONENTS)
    for batch in batches:
        cells = _matrix(batch.column("cells")).astype(float)
        n += len(cells)
        total += cells.sum(axis=0)
        squares += (cells ** 2).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(COMPONENTS), pa.int32()), pa.array([n] * COMPONENTS, pa.int64()), pa.array(total),
             pa.array(squares)], ["place", "n", "total", "squares"])


def zone_maps(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of Hilbert neighbours with their boxes and sums, staged. Equal vectors are spread by their ids."""
    rows = vectors.mapInArrow(_moments, "place int, n long, total double, squares double").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).toPandas()
    rows = rows.sort_values("place")
    mean = (rows["total"] / rows["n"]).to_numpy()
    wide = 4 * np.sqrt(np.maximum((rows["squares"] / rows["n"]).to_numpy() - mean ** 2, 1e-9))

    def keyed(batches):
        for batch in batches:
            cells = _matrix(batch.column("cells"))
            grid = np.clip(np.floor(((cells - mean) / wide + 0.5) * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(grid, BITS), pa.binary())],
                                             ["vec_id", "cells", "place"])

    def packed(batches):
        ids, parts, held = [], [], 0

        def one():
            m = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(m)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), *(
                    pa.array([a.tobytes()], pa.binary()) for a in (
                        m, m.min(axis=0), m.max(axis=0), m.sum(axis=0, dtype=np.int64)))],
                ["n", "ids", "cells", "lo", "hi", "total"])

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                piece = batch.slice(start, block - held)
                start += piece.num_rows
                held += piece.num_rows
                ids += piece.column("vec_id").to_pylist()
                parts.append(_matrix(piece.column("cells")))
                if held == block:
                    yield one()
                    ids, parts, held = [], [], 0
        if held:
            yield one()

    ordered = staged(vectors.mapInArrow(keyed, "vec_id long, cells binary, place binary"), "zone-keys")
    spread = F.xxhash64("vec_id")
    blocks = staged(ordered.repartitionByRange("place", spread).sortWithinPartitions("place", spread).mapInArrow(
        packed, _BLOCKS), "zone-maps")
    discard(ordered)
    return blocks


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of a box, ascending.

    The centroid whose farthest point of the box is nearest is the measure: another is a candidate if some point of the
    box is at least as near to it. The difference of the two squared distances is linear in the point, so its extreme
    lies in a corner that is read off component by component.
    """
    farthest = np.maximum(np.abs(centroids - lo), np.abs(hi - centroids))
    best = centroids[(farthest ** 2).sum(axis=1).argmin()]
    lead = np.where(centroids > best, hi, lo) * (centroids - best) * 2 + best ** 2 - centroids ** 2
    return np.flatnonzero(lead.sum(axis=1) >= 0)


def nearest(cells: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of some centroids (the smallest of equally near ones) and squared distance, exactly."""
    distances = np.empty((len(among), len(cells)), np.int64)
    for i, c in enumerate(among):
        away = cells - centroids[c]
        distances[i] = np.einsum("ij,ij->i", away, away)
    best = distances.argmin(axis=0)
    return among[best], distances[best, np.arange(len(cells))]


def _boxes(batches):
    """Box, number, sums and a way to the vectors of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            lo, hi = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in ("lo", "hi"))
            yield batch, i, lo, hi


def _cells(batch, i: int) -> np.ndarray:
    return np.frombuffer(batch.column("cells")[i].as_py(), np.int32).reshape(-1, COMPONENTS).astype(np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored means of their vectors; those without any stay."""
    def sums(batches):
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch, i, lo, hi in _boxes(batches):
            among = candidates(lo, hi, centroids)
            if len(among) == 1:
                total[among[0]] += np.frombuffer(batch.column("total")[i].as_py(), np.int64)
                count[among[0]] += batch.column("n")[i].as_py()
                continue
            cells = _cells(batch, i)
            chosen, _ = nearest(cells, centroids, among)
            for c in among:
                mine = chosen == c
                total[c] += cells[mine].sum(axis=0)
                count[c] += mine.sum()
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))],
            ["cluster", "n", "total"])

    rows = blocks.mapInArrow(sums, "cluster int, n long, total array<long>").groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(COMPONENTS)]).alias("total")).collect()
    after = centroids.copy()
    for row in rows:
        after[row["cluster"]] = np.array(row["total"], np.int64) // row["n"]
    return after


def clusters(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", count: int = CENTROIDS,
             rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly ``COMPONENTS`` components, none null or non-finite; null vectors are not. Components so
    large that squared distances do not fit 64 bits (``floor(64 x)`` of 2^27 or more) count as non-finite. The ``count`` kept rows with the smallest
    SHA-256 of ``1:<vec_id>`` are the first centroids; rows that repeat an id are ordered by their components, and a
    null id counts as an empty text. Fewer rows than that are all centroids. Of equally near centroids the smaller
    number wins; repeated rows each get their result; no kept vector: no rows. Other columns are not looked at.
    Centroids, their sums and digests are all that reaches the driver: ``count`` rows a task round at most.
    """
    spark = python_ready(rows)
    vectors = staged(rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"),
    ).mapInArrow(_usable, "vec_id long, cells binary"), "cluster-vectors")
    order = F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select("cells", order.alias("place")).orderBy("place", "cells").limit(count).collect()
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], names)
    centroids = np.stack([np.frombuffer(row["cells"], np.int32) for row in first]).astype(np.int64)
    blocks = zone_maps(vectors)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def assigned(batches):
        for batch, i, lo, hi in _boxes(batches):
            chosen, distance = nearest(_cells(batch, i), centroids, candidates(lo, hi, centroids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, pa.array(chosen, pa.int32()), pa.array(distance)],
                ["vec_id", "cluster", "distance"])

    found = staged(blocks.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters")
    discard(blocks)
    discard(vectors)
    per_cluster = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    whole = sum(per_cluster.values())
    about = spark.createDataFrame(
        [(c, d, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, d in per_cluster.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid: ``count`` at most.
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds as common table expressions over one row per vector and component."""
    parts = [f"""
rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
kept AS (
  SELECT r, vec_id, x FROM rows
  WHERE len(x) = {COMPONENTS} AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = {COMPONENTS}),
cells AS MATERIALIZED (
  SELECT r, i, floor({SCALE} * x[i])::BIGINT AS v FROM kept, range(1, {COMPONENTS + 1}) t(i)),
firsts AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id::VARCHAR)) - 1 AS c FROM kept
  QUALIFY c < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT c, i, v FROM firsts JOIN cells USING (r))"""]
    for turn in range(ROUNDS + 1):
        parts.append(f"""
d{turn} AS (
  SELECT r, c, sum((a.v - b.v) * (a.v - b.v))::BIGINT AS d FROM cells a JOIN c{turn} b USING (i) GROUP BY r, c),
a{turn} AS MATERIALIZED (
  SELECT r, c, d FROM d{turn} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if turn < ROUNDS:
            parts.append(f"""
m{turn} AS (
  SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{turn} JOIN cells USING (r) GROUP BY c, i),
c{turn + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM c{turn} LEFT JOIN m{turn} USING (c, i))""")
    return "WITH " + ",".join(parts) + f""",
digests AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN digests USING (c)
"""


SQL = _sql()
