"""SimHash near-duplicates: fingerprints linked by a pigeonring search.

64 bits are cut into 16 segments of four. If two fingerprints differ in at most two bits, some chain of consecutive
segments (around the ring) has, at each length l, at most floor(2 l / 16) differing bits: none in its first seven
segments, one in its first fifteen, two in all. So a join on the first seven segments (28 bits) from each of the 16
starts finds every pair, and the longer chains discard most candidates before the full comparison. Equal fingerprints
are merged first, so copies, however many, meet the join once. Candidates are pairs of equal 28-bit keys: with d distinct
fingerprints some 8 d^2 / 2^28 of them, 3 a fingerprint at d = 10^8 and 300 at 10^10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import kept_rows, numbered, python_ready, staged, table, unused_name, with_row_id
from quire.llm.components import components

SHINGLE = 3
SEGMENTS = 16
DISTANCE = 2
SEED = 42



def fingerprint(text: bytes | None) -> int:
    """The 64 bits of a text, as a signed number; null, empty and blank texts: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = np.array(hashes[start:start + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("body").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("doc_id"), pa.array(map(fingerprint, texts), pa.int64())],
            ["row_id", "doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row_id: str | None = None) -> DataFrame:
    """``row_id, doc_id, fp`` of every row, staged."""
    python_ready(docs)
    docs = docs if row_id else with_row_id(docs, row_id := unused_name(docs, "row_id"))
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
                           F.col(text).cast("binary").alias("body"))
    return staged(rows.mapInArrow(_fingerprints, f"row_id {dict(rows.dtypes)['row_id']}, doc_id long, fp long"), "simhash")


def _from_start(fp: Column, start: int, width: int) -> Column:
    """The bits of a fingerprint read around the ring from one segment on."""
    shift = start * width
    return fp if not shift else F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, 64 - shift))


def linked(prints: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``u < v`` of the distinct fingerprints in ``fp`` that differ in at most ``distance`` bits."""
    width = 64 // segments
    allowed = [length * distance // segments for length in range(segments + 1)]
    exact = max(length for length in range(1, segments + 1) if allowed[length] == 0)
    ringed = prints.select("fp", F.posexplode(F.array(*[
        _from_start(F.col("fp"), s, width) for s in range(segments)])).alias("start", "ring"))
    keyed = ringed.select("fp", "ring", "start", F.shiftrightunsigned("ring", 64 - exact * width).alias("key"))
    # Each budget is checked at the longest chain that still has it; shorter chains differ in no more bits.
    differ = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    within = F.lit(True)
    for budget in range(1, distance + 1):
        longest = max(length for length in range(segments + 1) if allowed[length] <= budget)
        within = within & (F.bit_count(F.shiftrightunsigned(differ, 64 - longest * width)) <= budget)
    pairs = keyed.alias("a").join(keyed.alias("b"), (F.col("a.start") == F.col("b.start")) & (
        F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & within)
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row_id: str | None = None) -> DataFrame:
    """One row per input row: ``row_id, doc_id, fp, component_id, keep_row``.

    ``component_id`` is the smallest id reachable by links, ``keep_row`` the row that stays of the component: its
    smallest id, and of rows with that id the first. Null, empty and blank texts have fingerprint zero and link like
    any other; null ids lie above all others, and a component of null ids alone has a null id. Repeated rows share a
    fingerprint. An empty table gives no rows; other columns of the input are not looked at.
    """
    rows = fingerprints(docs, doc_id, text, row_id)
    order = F.coalesce(F.col("doc_id"), F.lit(2 ** 63 - 1).cast("long"))
    prints = staged(rows.groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.min_by("row_id", order).alias("first_row")), "simhash-prints")
    roots = components(linked(prints.select("fp")), "simhash-links")
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "first_row")
    named = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"),
        F.min_by("first_row", F.coalesce(F.col("least"), F.lit(2 ** 63 - 1).cast("long"))).alias("keep_row"))
    of_print = rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "keep_row")
    return rows.join(of_print, "fp").select("row_id", "doc_id", "fp", "component_id", "keep_row")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: its smallest id, and of repeated rows the first.

    Null, empty and blank texts share fingerprint zero, so one of them stays; null ids lie above all others; an empty table
    stays empty; columns may have any names. Rows are known by an identity that
    holds for all jobs (``numbered``).
    """
    name = unused_name(docs, "row_id")
    rows = numbered(docs, name)
    stay = near_duplicates(rows, row_id=name).where("row_id = keep_row").select(F.col("row_id").alias(name))
    return kept_rows(rows, stay, name)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                        (F.col("row_id") == F.col("keep_row")).alias("kept"))
