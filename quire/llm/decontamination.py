"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

The index holds one posting ``term, row_id, pos`` for every occurrence in the training texts of a term that a test item
has; it lies where the texts were read, so building it moves no text. A window of an item is looked up from its rarest
term: each occurrence, less the term's offset, is a place where the window may begin. These places are intersected with
the offset-adjusted list of the second rarest term, and what is left with those of all other terms at once. No step
joins on anything but equal keys, and a frequent term is only looked at where rarer ones were found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, lower_ascii, staged, table, with_row_id

# Digits, a-z and all beyond ASCII of a lower-cased text. Said positively: Java searches a complement of ranges 20 times slower.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW = 10


def _words(text) -> F.Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """``item_id, words`` of every window: ``length`` consecutive words; a shorter item, unless empty, is one window.

    Ids are texts; a null id counts as the empty one. Null texts have no words and so no window.
    """
    told = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"),
                        _words(F.col(text)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (length - 1), F.lit(1)))
    return told.withColumn("start", F.explode(starts)).select(
        "item_id", F.slice("all", F.col("start"), length).alias("words"))


def vocabulary(spans: DataFrame) -> DataFrame:
    """``word, term``: the distinct words of windows, numbered; staged, so that its numbers hold."""
    words = spans.select(F.explode("words").alias("word")).distinct()
    return staged(words.select("word", F.monotonically_increasing_id().alias("term")), "index-terms")


def build_index(rows: DataFrame, terms: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """Postings ``term, row_id, pos`` of the given terms (``word, term``) in whole texts, staged.

    ``row_id`` must be stored, not computed: later jobs refer to it. Null texts have no postings.
    """
    tokens = rows.select(F.col(row_id).alias("row_id"), F.posexplode(_words(F.col(text))).alias("pos", "word"))
    return staged(tokens.join(terms, "word").select("term", "row_id", "pos"), "index-postings")


def _ranked_windows(spans: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``win, lists`` of the distinct windows whose terms all occur: offset and term, rarest first; staged."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = terms.join(counts, "term", "left")
    cells = spans.select("words").distinct().select(
        "words", F.posexplode("words").alias("off", "word")).join(known, "word")
    listed = cells.groupBy("words").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))).alias("lists"))
    return staged(listed.where("lists[0].n > 0").select(
        F.monotonically_increasing_id().alias("win"), "words", F.size("lists").alias("length"), "lists"), "index-windows")


def _intersected(places: DataFrame, postings: DataFrame, ranked: DataFrame, rank: int) -> DataFrame:
    """Places (``row_id, at, win``) at which the term of a rank occurs too; windows too short for it stay as they are."""
    asked = places.join(ranked.where(F.size("lists") > rank).select(
        "win", F.col("lists")[rank]["off"].alias("off"), F.col("lists")[rank]["term"].alias("term")), "win").select(
        "row_id", "win", "at", (F.col("at") + F.col("off")).alias("pos"), "term")
    of_rank = postings.join(ranked.where(F.size("lists") > rank).select(
        F.col("lists")[rank]["term"].alias("term")).distinct(), "term", "left_semi")
    found = asked.join(of_rank, ["row_id", "pos", "term"]).select("row_id", "at", "win")
    short = places.join(ranked.where(F.size("lists") <= rank).select("win"), "win", "left_semi")
    return found.unionByName(short.select("row_id", "at", "win"))


def phrase_matches(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """``row_id, at, win``: every place at which a window occurs word for word, staged."""
    first = ranked.select("win", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["off"].alias("off"))
    places = postings.join(first, "term").select("row_id", (F.col("pos") - F.col("off")).alias("at"), "win").where("at >= 0")
    two = staged(_intersected(places, postings, ranked, 1), "index-two")
    # All further lists at once: a place holds the window if it meets every one of them.
    rest = ranked.where("length > 2").select("win", "length", F.explode(F.slice("lists", 3, 2 ** 31 - 1)).alias("x")).select(
        "win", "length", F.col("x.term").alias("term"), F.col("x.off").alias("off"))
    asked = two.join(rest, "win").select(
        "row_id", "at", "win", "length", (F.col("at") + F.col("off")).alias("pos"), "term")
    met = asked.join(postings, ["row_id", "pos", "term"]).groupBy("row_id", "at", "win").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("length")).where("n = length - 2").select("row_id", "at", "win")
    short = two.join(ranked.where("length <= 2").select("win"), "win", "left_semi").select("row_id", "at", "win")
    found = staged(met.unionByName(short), "index-phrases")
    discard(two)
    return found


def proximity_matches(postings: DataFrame, ranked: DataFrame, within: int) -> DataFrame:
    """``row_id, pos, win``: occurrences of a window's rarest term with every other term of it, in any order, at most
    ``within`` words away.

    Postings are dealt to stretches of ``within`` words, and an occurrence asks its own and both neighbouring
    stretches, so lists are joined by equal keys only.
    """
    stretch = F.floor(F.col("pos") / within).cast("int")
    first = ranked.select("win", F.col("lists")[0]["term"].alias("term"))
    rare = postings.join(first, "term").select("row_id", "pos", "win")
    others = ranked.select("win", F.explode(F.array_except(
        F.array_distinct("lists.term"), F.array(F.col("lists")[0]["term"]))).alias("term"))
    wanted = others.groupBy("win").agg(F.count(F.lit(1)).alias("wanted"))
    asked = rare.join(others, "win").select(
        "row_id", "win", "pos", "term", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    near = postings.select("row_id", "term", F.col("pos").alias("there"), F.floor(F.col("pos") / within).cast("int").alias("stretch"))
    met = asked.join(near, ["row_id", "term", "stretch"]).where(F.abs(F.col("pos") - F.col("there")) <= within)
    held = met.groupBy("row_id", "pos", "win").agg(F.count_distinct("term").alias("n"))
    alone = rare.join(wanted, "win", "left_anti")
    return held.join(wanted, "win").where("n = wanted").select("row_id", "pos", "win").unionByName(
        alone.select("row_id", "pos", "win"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """One row per input row: ``row_id, doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in any occurrence of a window of an item. Null and empty texts have no words; ids may be
    null or repeat, equal rows get equal results; items that repeat an id count as one, a null item id as the empty
    text; items without words are never found; windows that several items share are looked up once. Empty tables:
    without documents no rows, without items no hits. Other columns are not looked at.
    """
    rows = staged(with_row_id(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), "index-rows")
    spans = staged(windows(items, item_id, item_text, length).distinct(), "index-spans")
    terms = vocabulary(spans)
    postings = build_index(rows, terms)
    ranked = _ranked_windows(spans, terms, postings)
    found = phrase_matches(postings, ranked)
    hit = found.join(ranked.select("win", "length"), "win").select("row_id", "at", "length").distinct().select(
        "row_id", F.explode(F.expr("sequence(at, at + length - 1)")).alias("pos")).distinct().groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_hit"))
    of_item = ranked.join(spans, "words").select("win", "item_id")
    # A row's list has at most the items that share its words: the digest asks for it whole.
    held = found.select("row_id", "win").distinct().join(of_item, "win").groupBy("row_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("ids"))
    verdict = staged(hit.join(held, "row_id"), "index-hits")
    discard(found)
    discard(postings)
    none = F.array().cast("array<string>")
    return rows.select("row_id", "doc_id", F.regexp_count(lower_ascii(F.col("text")), F.lit(TERM)).cast("long").alias("n_words")).join(
        verdict, "row_id", "left").select(
        "row_id", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", none)).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[s : s + 9], ' ') AS gram
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s) WHERE len(words) > 0),
grams AS (
  SELECT r, s, size, array_to_string(words[s : s + size - 1], ' ') AS gram
  FROM docs, (SELECT DISTINCT size FROM wins), LATERAL (SELECT unnest(range(1, len(words) - size + 2)) AS s)),
found AS MATERIALIZED (SELECT r, s, size, item_id FROM grams JOIN wins USING (size, gram)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM found, LATERAL (SELECT unnest(range(s, s + size)) AS p) GROUP BY r),
held AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""
