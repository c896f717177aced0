"""Compare two keyed row sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """``kind``, the keys and ``changed_cols`` of every row that differs.

    ``kind`` is ``added``, ``removed``, ``modified`` or, for a key that is not
    unique on its side, ``duplicate``. One grouping over both sides takes the
    place of a full outer join: duplicates fold on the map side, so a key that
    many rows repeat stays small in the shuffle.
    """
    def tagged(rows: DataFrame, is_a: bool) -> DataFrame:
        values = F.struct(*compare) if compare else F.struct(F.lit(0).alias("_none"))
        return rows.select(
            *keys,
            F.lit(is_a).alias("_is_a"), F.lit(not is_a).alias("_is_b"), values.alias("_values"),
        )

    grouped = tagged(a, True).unionByName(tagged(b, False)).groupBy(*keys).agg(
        F.count_if("_is_a").alias("_na"),
        F.count_if("_is_b").alias("_nb"),
        F.max(F.when(F.col("_is_a"), F.col("_values"))).alias("_a"),
        F.max(F.when(F.col("_is_b"), F.col("_values"))).alias("_b"),
    )
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in compare
    ])) if compare else F.array().cast("array<string>")
    unique = (F.col("_na") <= 1) & (F.col("_nb") <= 1)
    kind = (
        F.when(~unique, "duplicate")
        .when(F.col("_na") == 0, "added")
        .when(F.col("_nb") == 0, "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    )
    return (
        grouped.select(
            kind.alias("kind"), *keys,
            F.when(kind == "modified", changed).otherwise(F.array().cast("array<string>")).alias("changed_cols"),
        )
        .filter(F.col("kind").isNotNull())
    )
