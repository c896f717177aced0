"""Embedding near-duplicates by NN-descent over representatives.

Vectors are compared within a label only. First, equal and nearly equal vectors are replaced by a representative: a
vector joins the ball of a hub if their angle is at most half the linking angle, so that all members of a ball link with
one another and copies, however many, need no pairs. A hub matters to another within the linking angle and both radii;
one that stands for itself alone has no radius. Then a neighbour graph over representatives is refined: it starts from blocks of
equal hyperplane codes, as long as each label's own size asks for, and each round compares neighbours of a node with
one another if at least one of the two is new to its list since the round before. Rounds end when few new neighbours, or
none that are near, turn up. The vectors in the lists are 16-bit integers; what is near by them is checked in double precision. A node whose list
holds only vectors near enough to matter is saturated; its list doubles and rounds go on. An audit compares a share of
the nodes with all of their label, and low recall enlarges all lists; a share without any near pair says nothing, so
larger shares are asked, up to ``AUDIT_MOST`` comparisons, and if none holds any the recall is null. At last members are
compared where two balls may link: by the triangle inequality most members link with all of a ball or with none, the
others are compared in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, python_ready, staged, table
from quire.llm.components import components

THRESHOLD = 0.93
NEIGHBOURS = 12
TABLES = 10
BLOCK = 64
# Rounds of gathering balls, and the hyperplanes of each, of which a label uses as many as leave ``2 ** -BALL_SPARE``
# vectors on average on one side of all: what meets there is nearly equal.
BALL_ROUNDS = 4
BALL_BITS = 44
BALL_SPARE = 3
# Hyperplanes of a table; a label uses as many as its size asks for, crowded blocks use more of them.
PLANES = 32
# Rounds end when fewer neighbours than this share of all places in the lists are new.
LEAST_CHANGE = 0.001
# One of so many nodes is audited, and at least so many where the table has them.
AUDITED_OF = 20
AUDITED = 256
# Comparisons of an audit at most, beyond the first share.
AUDIT_MOST = 1 << 36
LEAST_RECALL = 0.99
# Nodes in one block of the audit.
AUDIT_BLOCK = 512
# Rows of a local comparison held as cosines at a time.
STRIP = 1024
# Lists hold unit vectors as 16-bit integers; cosines by them are off by less than the margin, up to 16,000 components.
UNIT = 32767
MARGIN = 0.004
# Members in one tile of a comparison of two balls.
TILE = 256
SEED = 20

_VECTOR = "vec_id long, label long, vec binary"


def _usable(batches):
    """Unit vectors in double precision; null, zero and non-finite ones are left out."""
    for batch in batches:
        ids, labels, units = [], [], []
        for vec_id, label, values in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
            if not values or any(v is None for v in values):
                continue
            vector = np.array(values, float)
            largest = np.abs(vector).max()
            if not np.isfinite(largest) or largest == 0:
                continue
            vector /= largest
            ids.append(vec_id)
            labels.append(label)
            units.append((vector / np.linalg.norm(vector)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(units, pa.binary())],
            ["vec_id", "label", "vec"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1)


def _coded(rows: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """The rows with ``codes``: per table, on which side of ``bits`` random hyperplanes (fixed by the seed) each lies."""
    names = rows.columns

    def codes(batches):
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            found = [[] for _ in vectors]
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v) // 8, []).append(i)
            for size, at in by_size.items():
                planes = np.random.default_rng([seed, size]).standard_normal((size, tables * bits))
                sides = (_matrix([vectors[i] for i in at]) @ planes > 0).reshape(len(at), tables, bits)
                values = sides @ (1 << np.arange(bits))
                for i, row in zip(at, values):
                    found[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*names, "codes"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(codes, kinds + ", codes array<long>")


def _cosines(pairs: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """``keep`` and the cosine ``cos`` of two columns of unit vectors; vectors of unlike sizes: -1."""
    def cosines(batches):
        for batch in batches:
            a, b = batch.column(left).to_pylist(), batch.column(right).to_pylist()
            out = [float(np.dot(np.frombuffer(x), np.frombuffer(y))) if len(x) == len(y) else -1.0 for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.float64())], [*keep, "cos"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(cosines, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", cos double")


def balls(vectors: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, label, vec, hub, hub_cos``: the ball each vector belongs to, its own (cosine 1) if none; staged."""
    near = math.cos(math.acos(threshold) / 2) + 1e-12
    own = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("held")).select("label", F.least(
        F.ceil(F.log2("held")) + BALL_SPARE, F.lit(BALL_BITS)).cast("int").alias("bits"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    pending = staged(_coded(vectors, BALL_ROUNDS, BALL_BITS, SEED).join(own, "label").withColumn(
        "codes", F.transform("codes", lambda c: c.bitwiseAND(mask))).drop("bits"), "nn-codes")
    done = []
    for turn in range(BALL_ROUNDS):
        code = F.col("codes")[turn]
        hubs = pending.groupBy("label", code.alias("code"), F.length("vec").alias("size")).agg(
            F.min("vec_id").alias("hub"), F.min_by("vec", "vec_id").alias("hub_vec"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = pending.withColumn("code", code).withColumn("size", F.length("vec")).join(
            hubs.drop("n"), ["label", "code", "size"])
        close = _cosines(met, "vec", "hub_vec", ["vec_id", "hub"]).where(F.col("cos") >= near)
        close = staged(close, "nn-close")
        real = close.where("vec_id <> hub").select("hub").distinct()
        joined = close.join(real, "hub")
        done.append(joined)
        left = staged(pending.join(joined.select("vec_id"), "vec_id", "left_anti"), "nn-codes")
        discard(pending)
        pending = left
    inside = done[0]
    for more in done[1:]:
        inside = inside.unionByName(more)
    return staged(vectors.join(inside, "vec_id", "left").select(
        "vec_id", "label", "vec", F.coalesce("hub", "vec_id").alias("hub"),
        F.when(F.col("vec_id") == F.coalesce("hub", "vec_id"), 1.0).otherwise(F.col("cos")).alias("hub_cos")), "nn-balls")


def _best(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The largest cosines of each node, as many as its list holds; ``fresh`` where no old edge is among the equal ones."""
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    ranked = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh")).withColumn(
        "rank", F.row_number().over(order))
    return ranked.join(sizes.select("u", "most"), "u").where("rank <= most").select("u", "v", "cos", "fresh")


def _light(nodes: DataFrame) -> DataFrame:
    """``vec_id, label, size, code``: unit vectors as 16-bit integers, staged."""
    def coded(batches):
        for batch in batches:
            codes = [np.rint(np.frombuffer(v) * UNIT).astype(np.int16).tobytes() for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(map(len, codes), pa.int32()),
                 pa.array(codes, pa.binary())], ["vec_id", "label", "size", "code"])

    return staged(nodes.mapInArrow(coded, "vec_id long, label long, size int, code binary"), "nn-light")


def _compared(lists: DataFrame) -> DataFrame:
    """``u, v, cos`` of the pairs of each list with a fresh member that may better the list of ``u``.

    ``lists`` has ``members``, an array of ``v, fresh, worst, most, code`` of vectors of one size. A list gives each of
    its members half as many as it has room for, the nearest: others meet again elsewhere, or in the next round.
    """
    def pairs(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                rows = batch.column("members")[i].values
                ids = rows.field("v").to_numpy()
                fresh = rows.field("fresh").to_numpy(zero_copy_only=False)
                if len(ids) < 2 or not fresh.any():
                    continue
                worst, room = rows.field("worst").to_numpy(), rows.field("most").to_numpy()
                m = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.int16).reshape(len(ids), -1).astype(np.float32)
                m /= UNIT
                for start in range(0, len(ids), STRIP):
                    stop = min(start + STRIP, len(ids))
                    cos = m[start:stop] @ m.T
                    cos[np.arange(stop - start), np.arange(start, stop)] = -2
                    cos[np.ix_(~fresh[start:stop], ~fresh)] = -2
                    half = np.minimum(room[start:stop] // 2, len(ids)) - 1
                    floor = -np.sort(-cos, axis=1)[np.arange(stop - start), half]
                    a, b = np.nonzero((cos > worst[start:stop, None]) & (cos >= floor[:, None]))
                    found.append((ids[start + a], ids[b], cos[a, b]))
            if found:
                u, v, cos = (np.concatenate(x) for x in zip(*found))
                # A pair met in several lists goes on once.
                order = np.lexsort((v, u))
                u, v, cos = u[order], v[order], cos[order]
                first = np.ones(len(u), bool)
                first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
                u, v, cos = u[first], v[first], cos[first]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(cos, pa.float32())], ["u", "v", "cos"])

    return lists.select("members").mapInArrow(pairs, "u long, v long, cos float")


def _start(light: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours within blocks of equal codes.

    A label has as many bits as leave a third of ``BLOCK`` in a block on average. Blocks that are larger than ``BLOCK``
    are divided by further bits, and what is too large still is dealt by id, so that each compares ``BLOCK`` or so.
    """
    own = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("held")).select(
        "label", F.least(F.greatest(F.round(F.log2(F.col("held") * 3 / BLOCK)), F.lit(1)), F.lit(PLANES - 8)).cast("int").alias("bits"))
    one = F.lit(1).cast("long")
    coded = _coded(nodes, TABLES, PLANES, SEED + 1).select(
        "vec_id", "label", F.length("vec").alias("size"), F.posexplode("codes").alias("turn", "all")).join(
        own, "label").withColumn("code", F.col("all").bitwiseAND(F.call_function("shiftleft", one, F.col("bits")) - 1))
    coded = staged(coded, "nn-codes")
    keys = ["label", "turn", "code", "size"]
    counted = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    more = F.greatest(F.ceil(F.log2(F.col("n") / BLOCK)), F.lit(0)).cast("int")
    divided = coded.join(counted, keys).withColumn("rest", F.call_function(
        "shiftright", F.col("all"), F.col("bits")).bitwiseAND(F.call_function("shiftleft", one, more) - 1)).drop("n", "all", "bits")
    keys = [*keys, "rest"]
    parts = divided.join(divided.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), keys).withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "turn"), F.ceil(F.col("n") / BLOCK)))
    blocks = parts.select(*[k for k in keys if k not in ("code", "size", "label")], "part", "vec_id", F.col("code").alias("own")).join(
        light, "vec_id").groupBy("label", "turn", "own", "size", "rest", "part").agg(F.collect_list(F.struct(
            F.col("vec_id").alias("v"), F.lit(True).alias("fresh"), F.lit(-1.0).cast("float").alias("worst"),
            F.lit(NEIGHBOURS).alias("most"), "code")).alias("members"))
    return _compared(blocks).withColumn("fresh", F.lit(True))


def _round(graph: DataFrame, light: DataFrame, sizes: DataFrame) -> DataFrame:
    """Compare the neighbours of every node with one another where one is fresh; keep the best of old and new."""
    back = Window.partitionBy("v").orderBy(F.desc("cos"), "u")
    reverse = graph.withColumn("rank", F.row_number().over(back)).join(
        sizes.select(F.col("u").alias("v"), "most"), "v").where("rank <= most").select(
        F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    lists = graph.select("u", "v", "fresh").unionByName(reverse).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("u").agg(F.min("cos").alias("worst"), F.count(F.lit(1)).alias("held"))
    about = light.join(sizes.join(worst, "u", "left").select(
        F.col("u").alias("vec_id"), "most", F.when(F.col("held") >= F.col("most"), F.col("worst")).otherwise(
            F.lit(-1.0)).cast("float").alias("worst")), "vec_id").select(F.col("vec_id").alias("v"), "worst", "most", "code")
    met = lists.join(about, "v").groupBy("u").agg(F.collect_list(F.struct("v", "fresh", "worst", "most", "code")).alias("members"))
    found = _compared(met).withColumn("fresh", F.lit(True))
    return staged(_best(graph.withColumn("fresh", F.lit(False)).unionByName(found), sizes), "nn-graph")


def _packed(nodes: DataFrame, part: str) -> DataFrame:
    """Blocks of nodes of a label and size: ``label, size, part, parts, rows``, some ``AUDIT_BLOCK`` nodes each."""
    sized = nodes.select("vec_id", "label", "vec", "radius", F.length("vec").alias("size"))
    parts = sized.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / AUDIT_BLOCK).alias("parts"))
    dealt = sized.join(parts, ["label", "size"]).withColumn(part, F.pmod(F.xxhash64("vec_id", F.lit(part)), "parts"))
    return dealt.groupBy("label", "size", "parts", part).agg(
        F.collect_list(F.struct("vec_id", "vec", "radius")).alias(f"{part}_rows"))


def true_pairs(nodes: DataFrame, count: int, reach: float, of: int = AUDITED_OF) -> DataFrame:
    """``u, v``: the neighbours ``v`` that matter to the audited nodes ``u``, one in ``of``, by comparing them with all
    of their label; staged. They lie within the angle ``reach`` and both radii.
    """
    share = max(1 / of, AUDITED / max(count, 1))
    asked = nodes if share >= 1 else nodes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    left, right = staged(_packed(asked, "ask").drop("parts"), "nn-asked"), staged(_packed(nodes, "all"), "nn-blocks")
    keys = ["label", "size"]
    # A block asks for the blocks of its label by their numbers: no key stands for a whole label.
    tiles = left.join(right.select(*keys, "parts").distinct(), keys).withColumn(
        "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = tiles.join(right.drop("parts"), [*keys, "all"]).select("ask_rows", "all_rows")

    def truth(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values for c in ("ask_rows", "all_rows"))
                u, v = (x.field("vec_id").to_numpy() for x in (a, b))
                near = np.cos(np.add.outer(a.field("radius").to_numpy() + reach, b.field("radius").to_numpy()))
                at, to = np.nonzero(_matrix(a.field("vec").to_pylist()) @ _matrix(b.field("vec").to_pylist()).T >= near)
                other = u[at] != v[to]
                yield pa.RecordBatch.from_arrays([pa.array(u[at][other]), pa.array(v[to][other])], ["u", "v"])

    found = staged(met.mapInArrow(truth, "u long, v long"), "nn-audit")
    discard(left)
    discard(right)
    return found


def _audited(nodes: DataFrame, count: int, reach: float) -> DataFrame:
    """True pairs of the first share of nodes, or of as many more as it takes to hold any."""
    of = AUDITED_OF
    true = true_pairs(nodes, count, reach)
    pairs = None
    while of > 1 and true.isEmpty():
        pairs = pairs if pairs is not None else nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
            F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0
        of = max(1, of // 4)
        if pairs / of > AUDIT_MOST:
            break
        discard(true)
        true = true_pairs(nodes, count, reach, of)
    return true


def _audit(graph: DataFrame, true: DataFrame) -> float | None:
    """Share of the true near pairs that the graph holds, either way; None where there are none to judge by."""
    both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    wanted, held = true.count(), true.join(both, ["u", "v"], "left_semi").count()
    return held / wanted if wanted else None


def neighbour_graph(nodes: DataFrame, reach: float) -> tuple[DataFrame, float | None]:
    """``u, v, cos`` with every pair found, and the audited recall of pairs that matter (None: unknown).

    ``nodes`` has ``vec_id, label, vec, radius``. Two of them matter to each other within the angle ``reach`` and both
    radii, so it is enough if the one with the larger radius looks as far as ``reach`` and twice its own. ``cos`` is by
    16-bit vectors: off by less than ``MARGIN``.
    """
    count = nodes.count()
    light = _light(nodes)
    far = F.least(F.lit(reach) + 2 * F.col("radius"), F.lit(math.pi))
    sizes = staged(nodes.select(F.col("vec_id").alias("u"), F.lit(NEIGHBOURS).alias("most"), (F.cos(far) - MARGIN).alias("need")), "nn-sizes")
    graph = staged(_best(_start(light, nodes), sizes), "nn-graph")
    true = _audited(nodes, count, reach)
    least = NEIGHBOURS
    while True:
        quiet = False
        while True:
            better = _round(graph, light, sizes)
            discard(graph)
            graph = better
            fresh, close = graph.where("fresh").join(sizes.select("u", "need"), "u").agg(
                F.count(F.lit(1)), F.count_if(F.col("cos") >= F.col("need"))).first()
            # Two rounds in a row without a new near pair, or hardly any change, end the refining.
            if fresh <= LEAST_CHANGE * count * NEIGHBOURS or not close and quiet:
                break
            quiet = not close
        recall = _audit(graph, true)
        full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("held"), F.min("cos").alias("worst")).join(sizes, "u").where(
            (F.col("held") >= F.col("most")) & (F.col("worst") >= F.col("need"))).select("u")
        full = staged(full, "nn-full")
        # Lists end to grow by themselves: none is saturated once it has room for all nodes.
        saturated = full.count()
        low = recall is not None and recall < LEAST_RECALL and least < count
        if not saturated and not low:
            discard(true)
            discard(light)
            discard(full)
            return graph, recall
        least *= 1 if saturated else 2
        grow = F.coalesce("full", F.lit(False)) if saturated else F.lit(True)
        larger = staged(sizes.join(full.withColumn("full", F.lit(True)), "u", "left").select(
            "u", F.when(grow, F.col("most") * 2).otherwise(F.col("most")).alias("most"), "need", grow.alias("grown")), "nn-sizes")
        discard(sizes)
        discard(full)
        sizes = larger
        # What was dropped from a list that has grown may come back: its neighbours count as new.
        again = staged(graph.join(larger.select("u", "grown"), "u").select("u", "v", "cos", F.col("grown").alias("fresh")), "nn-graph")
        discard(graph)
        graph = again


def _tiles(members: DataFrame, wanted: DataFrame, by: list[str], name: str) -> DataFrame:
    """Vectors of the groups in ``wanted`` (columns ``by``), ``TILE`` or so in a row: ``by..., name_tile, name_rows``."""
    rows = members.join(wanted, by)
    parts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    return rows.join(parts, by).groupBy(*by, F.pmod(F.xxhash64("vec_id"), "parts").alias(f"{name}_tile")).agg(
        F.collect_list(F.struct("vec_id", "vec")).alias(f"{name}_rows"))


def _member_links(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, hub, other, n``: how many vectors of another ball each member links with (those with any)."""
    hubs = members.groupBy("hub").agg(
        F.count(F.lit(1)).alias("size"), F.min("hub_cos").alias("least"),
        F.min_by("vec", F.col("vec_id") != F.col("hub")).alias("hub_vec"))
    sides = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    met = members.join(sides, members["hub"] == sides["u"]).join(
        hubs.select(F.col("hub").alias("other"), "size", "least", "hub_vec"), F.col("v") == F.col("other"))
    seen = staged(_cosines(met, "vec", "hub_vec", ["vec_id", "hub", "other", "size", "least"]), "nn-members")
    angle, radius = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))), F.acos(F.least("least", F.lit(1.0)))
    reach = math.acos(threshold)
    whole = angle + radius <= reach - 1e-7
    none = angle - radius >= reach + 1e-7
    alone = F.col("size") == 1
    sure = seen.where(alone & (F.col("cos") >= threshold) | ~alone & whole).select(
        "vec_id", "hub", "other", F.col("size").alias("n"))
    open_ = staged(seen.where(~alone & ~whole & ~none).select("vec_id", "hub", "other"), "nn-open")
    one = members.select("vec_id", "vec", "hub")
    # Tiles of the undecided members of a ball meet tiles of the other ball: two large balls are many small tasks.
    asking = _tiles(one.drop("hub").join(open_, "vec_id"), open_.select("hub", "other").distinct(), ["hub", "other"], "ask")
    asked = _tiles(one.withColumnRenamed("hub", "other"), open_.select("other").distinct(), ["other"], "all")
    both = asking.join(asked.groupBy("other").agg(F.max("all_tile").alias("last")), "other").withColumn(
        "all_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).join(asked, ["other", "all_tile"])

    def counted(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values for c in ("ask_rows", "all_rows"))
                n = (_matrix(a.field("vec").to_pylist()) @ _matrix(b.field("vec").to_pylist()).T >= threshold).sum(axis=1)
                some = n > 0
                ids = a.field("vec_id").to_numpy()[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), *(pa.array([batch.column(c)[i].as_py()] * len(ids), pa.int64()) for c in ("hub", "other")),
                     pa.array(n[some].astype(np.int64))], ["vec_id", "hub", "other", "n"])

    found = both.select("hub", "other", "ask_rows", "all_rows").mapInArrow(
        counted, "vec_id long, hub long, other long, n long").groupBy("vec_id", "hub", "other").agg(F.sum("n").alias("n"))
    return sure.unionByName(found)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD) -> tuple[DataFrame, float | None]:
    """One row per input row, ``vec_id, n_links, component_id, kept``, and the audited recall (None: no audited
    vector has a near one, so nothing is known).

    Vectors link when their labels are equal and not null and their cosine is at least ``threshold``. Null, empty and
    zero vectors, those that hold null or non-finite components, and rows without id or label link with nothing, as do
    vectors of unlike sizes. Ids are taken as unique: rows that repeat an id count as one vector (any of them) and each
    get its result. Ties in the lists are ordered by id. An empty table gives no rows; other columns are not looked at.
    """
    python_ready(rows)
    slim = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.col(embedding).cast("array<double>").alias("embedding"))
    vectors = staged(slim.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").dropDuplicates(
        ["vec_id"]).mapInArrow(_usable, _VECTOR), "nn-vectors")
    members = balls(vectors, threshold)
    radii = members.groupBy("hub").agg(F.acos(F.greatest(F.least(F.min("hub_cos"), F.lit(1.0)), F.lit(-1.0))).alias("radius"))
    nodes = staged(members.where("vec_id = hub").select("vec_id", "label", "vec").join(
        radii.withColumnRenamed("hub", "vec_id"), "vec_id"), "nn-nodes")
    reach = math.acos(threshold)
    graph, recall = neighbour_graph(nodes, reach)
    sides = [nodes.select(F.col("vec_id").alias(side), F.col("radius").alias(f"radius_{side}")) for side in "uv"]
    near = graph.join(sides[0], "u").join(sides[1], "v").where(
        F.col("cos") >= F.cos(F.least(F.lit(reach) + F.col("radius_u") + F.col("radius_v"), F.lit(math.pi))) - MARGIN)
    links = staged(_member_links(members, near, threshold), "nn-links")
    roots = components(links.select(F.col("hub").alias("u"), F.col("other").alias("v")), "nn-components")
    within = members.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
    rooted = within.join(roots, within["hub"] == roots["node"], "left").select(
        "hub", "size", "least", F.coalesce("root", "hub").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    outside = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    found = members.select("vec_id", "hub").join(named, "hub").join(outside, "vec_id", "left").select(
        "vec_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    every = slim.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall


def query(spark, sf_dir: str) -> DataFrame:
    found, recall = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("audited_recall", F.lit(recall).cast("double"))
