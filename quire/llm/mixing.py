"""Mix sources to target weights: whole epochs first, then weighted sampling without replacement.

Every document gets the key -ln(u) / quality, u uniform and fixed by its id and text: taking documents by ascending
key until a budget is used up is Efraimidis-Spirakis sampling with the qualities as weights. A source whose target is
e times its size and a rest takes all its documents e times, and the rest by keys.

A source may hold a third of all rows, so its prefix sums are not one sorted run: keys are dealt to ``SLICES`` slices
per source, slices are summed and accumulated (a small table), and only the rows of one slice are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, numbered, staged, table, unused_name, with_row_id

MOST_EPOCHS = 3
# Slices of a source: each sorts 1/4096 of it, 2.4 million rows of a source of ten thousand million.
SLICES = 4096
# Characters that mark junk rather than prose; a document's quality is 1 / (1 + marks per word).
MARKS = r"[#$%&*|<>{}=^~]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: the share of all words each source is to give.

    Sources by code point, null last, weigh 1, 2, 3 and again. A target stops at three times its source's size and
    the excess is shared anew by weight. That fixed point is a water level: with sources by ascending
    cap / weight, a source is capped while its cap lies below its share of what the earlier caps left.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    rated = sizes.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("double")).withColumn(
        "cap", (F.col("source_size") * MOST_EPOCHS).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (
        rated.withColumn("words", F.sum("source_size").over(whole).cast("double"))
        .withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
        # The level of the first source that is not capped holds for all after it.
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
            by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        row_id: str | None = None) -> DataFrame:
    """One row per document: ``row_id, doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words (null text: 0), ``copies`` how often the mix holds the document, ``taken`` is size times
    copies. Documents go in whole; the one that crosses its source's budget goes in when that comes nearer to the
    target. Documents without words take part as often as their neighbours by key. Null sources form a source of
    their own; null ids are keyed by their text; equal rows have equal keys, and ties are ordered by id, so the sums
    agree between runs. A table without words has targets of zero and takes each document zero times; an empty table
    gives no rows. Other columns of the input are not looked at. ``row_id`` names a column that numbers the rows.
    """
    docs = docs if row_id else with_row_id(docs, row_id := unused_name(docs, "row_id"))
    body = F.coalesce(F.col(text), F.lit(""))
    # The first 52 bits of a digest, moved off zero: uniform on (0, 1).
    bits = F.conv(F.substring(F.md5(F.concat(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.sha2(body.cast("binary"), 256),
    ).cast("binary")), 1, 13), 16, 10).cast("double")
    quality = 1 / (1 + F.col("marks") / F.greatest("size", F.lit(1)))
    keyed = docs.select(
        F.col(row_id).alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"), _count(body, WORD).alias("size"),
        _count(body, MARKS).alias("marks"), ((bits + 0.5) / 2.0 ** 52).alias("u"),
    ).withColumn("key", -F.ln("u") / quality).drop("marks")
    # An ordered slice of the key, close to even for any quality: no slice gathers the tail of junk documents.
    share = F.col("key") / (1 + F.col("key"))
    keyed = staged(keyed.withColumn("slice", F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("int")), "mix-keys")

    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(F.lit(0)).cast("long")
    running = Window.partitionBy("source").orderBy("slice")
    bounds = slices.withColumn("before", F.sum("words").over(running) - F.col("words")).withColumnRenamed("source", "s").join(
        targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")),
        F.col("s").eqNullSafe(F.col("source"))).drop("source").withColumnRenamed("slice", "k")
    placed = keyed.join(bounds, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).drop("s", "k")

    # Only the slice that a source's budget ends in is sorted; all others lie wholly inside or outside.
    ends_here = (F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "u", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cut = placed.where(ends_here).withColumn("ahead", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    rest = placed.where(~ends_here).withColumn("ahead", F.col("before").cast("long"))
    by_size = F.col("ahead") + F.col("size") / 2 <= F.col("budget")
    open_budget = (F.col("budget") > 0) & (F.col("epochs") < MOST_EPOCHS)
    whole = F.col("before") + F.col("words") < F.col("budget")
    ruled = cut.withColumn("extra", by_size).unionByName(rest.withColumn("extra", whole))
    return ruled.withColumn("copies", F.col("epochs") + (F.col("extra") & open_budget).cast("long")).select(
        "row_id", "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Null texts have no words and are taken as their neighbours by key are; null sources are a source; repeated rows are
    each a document; an empty table stays empty; columns may have any names. Rows are known by an identity that holds
    for all jobs (``numbered``).
    """
    name = unused_name(docs, "row_id")
    rows = numbered(docs, name)
    turns = mix(rows, row_id=name).where("copies > 0").select(
        F.col("row_id").alias(name), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("turn"))
    return rows.join(turns.select(name), name).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#$%&*|<>{}=^~]')) AS marks,
         (('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || sha256(coalesce(text, '')))[1:13])::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / (1::DOUBLE / (1::DOUBLE + marks::DOUBLE / greatest(size, 1))) AS key FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight
  FROM keyed GROUP BY source),
shares AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place
  FROM sources),
levels AS (
  SELECT arg_min(rest / open_weight, place) FILTER (cap > rest / open_weight * weight) AS level FROM shares),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target
  FROM shares, levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs
  FROM targets),
placed AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.u, k.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS ahead
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN ahead + size / 2.0::DOUBLE <= budget AND budget > 0 AND epochs < 3 THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM placed
"""
