"""Exact deduplication of texts without any hot group in one task (DataFrame functions only).

Three rounds, each grouping by digest *and* whole text, so that equal digests of different texts never merge:

1. each input partition combines its own copies (the map side of the first aggregation),
2. partitions are dealt to ``salts`` salts; the winners of equal texts in one salt merge,
3. the at most ``salts`` winners of a text merge into the one that stays.

Every row then looks up the winner of its digest, again by digest and salt. Should one digest ever belong to two texts, that lookup stops the
job instead of naming a wrong winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import kept_rows, lower_ascii, numbered, table, unused_name, with_row_id

# Salts of the second round, 63 at most: a text held by a third of all rows reaches this many tasks, once per input partition.
SALTS = 32

_LEAST = -(2 ** 63)


def _latest(row: str, doc: str) -> Column:
    return F.max_by(row, F.coalesce(F.col(doc), F.lit(_LEAST))).alias("keep_row")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row_id: str | None = None,
                salts: int = SALTS) -> DataFrame:
    """One row per input row: ``row_id, doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, texts of any length are
    compared whole. The row with the largest id stays; null ids lie below all others, and of rows that repeat one id
    and one text one stays. An empty table gives no rows; other columns of the input are not looked at.
    ``row_id`` names a column that numbers the rows; without it the rows of the scan are numbered here.
    """
    docs = docs if row_id else with_row_id(docs, row_id := unused_name(docs, "row_id"))
    rows = docs.select(
        F.col(row_id).alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
        lower_ascii(F.col(text)).alias("body"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))

    # Copies in one input partition or file share a salt: the upper bits of a row number are its partition, and what
    # follows the colon of an address is its file.
    long_id = dict(rows.dtypes)["row_id"] == "bigint"
    part = F.shiftrightunsigned(F.col("row_id"), 33) if long_id else F.xxhash64(F.substring_index("row_id", ":", -1))
    salt = F.pmod(part, F.lit(salts)).cast("int")
    salted = rows.groupBy("digest", "body", salt.alias("salt")).agg(
        _latest("row_id", "doc_id"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = salted.groupBy("digest", "body").agg(
        _latest("keep_row", "keep_id"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salted"))
    by_digest = winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_row").alias("keep_row"), F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"), F.bit_or("salted").alias("salted"))
    # One row per salt that holds the text: copies look their winner up in as many tasks as they were dealt to.
    by_salt = by_digest.withColumn("salt", F.explode(F.expr(
        f"filter(sequence(0, {salts - 1}), s -> shiftrightunsigned(salted, s) & 1 = 1)")))

    one_text = F.when(F.col("texts") == 1, F.col("keep_row")).otherwise(
        F.raise_error(F.lit("two texts share one SHA-256 digest")).cast(dict(rows.dtypes)["row_id"]))
    return (
        rows.select("row_id", "doc_id", "digest", salt.alias("salt")).join(by_salt, ["digest", "salt"])
        .withColumn("keep_row", one_text)
        .select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest id, and one row only.

    Null texts are empty texts, null ids lie below all others; of rows that repeat id and text one stays; an empty table
    stays empty; columns may have any names. Rows are known by an identity that
    holds for all jobs (``numbered``).
    """
    name = unused_name(docs, "row_id")
    rows = numbered(docs, name)
    stay = exact_dedup(rows, row_id=name).where("kept").select(F.col("row_id").alias(name))
    return kept_rows(rows, stay, name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM rows
"""
