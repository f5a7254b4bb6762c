"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Words are stretches of letters and digits, lower-cased; a shingle is five words in a row (a shorter text is one
shingle), held as a 64-bit hash. An item is found in a document when at least 80 % of its shingles are.

Items are put into size classes (``(U/2, U]`` shingles). Of an item in class ``U`` the ``floor(0.2 U) + 1`` least
hashes are its minima; shingles that fewer items have come first, so a lead that many items share is no minimum while
an item has others. A document that holds 80 % of the shingles misses at most ``0.2 U`` of them, so it holds a
minimum: looking up minima, and documents with enough shingles of items, finds every answer and none is lost to chance.
Candidates are then counted exactly, shingle by shingle.

One pass over the documents keeps only shingles that some item has. The table of the items' shingles is sent to all
executors only while it has at most ``SENT_ROWS`` rows (16 MB); beyond, the same join shuffles.

Nulls and edges: a null text, and a text without words, holds nothing and is in nothing; null ids never match and
their rows stay in ``clean``, but are searched one by one in ``clean_rows``; repeated documents or items give one row per pair of ids; rows that share an id count
together, as one text that has the shingles of all; an empty table gives no matches; the length of a text is not limited; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import stored

WORDS = 5
#: Least containment, as a ratio of whole numbers.
OVER, UNDER = 4, 5
SENT_ROWS = 1_000_000
SEPARATOR = r"[^\p{L}\p{N}]+"


def _shingled(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and its different shingle hashes, as an array (empty without words)."""
    split = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATOR), "")
    # As the one element of a generator, the words are computed once; a plain projection would be copied into the lambda.
    split = rows.where(F.col(key).isNotNull()).select(key, F.explode(F.array(split)).alias("words"))
    word: Column = F.col("words")
    run = F.transform(F.sequence(F.lit(0), F.size(word) - WORDS),
                      lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WORDS)]))
    short = F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", word)))
    none = F.array().cast("array<bigint>")
    return split.select(key, F.array_distinct(
        F.when(F.size(word) >= WORDS, run).when(F.size(word) > 0, short).otherwise(none)).alias("shingles"))


def _sent(df: DataFrame, n: int) -> DataFrame:
    """Marked for broadcast while the counted size allows it."""
    return F.broadcast(df) if n <= SENT_ROWS else df


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle, q (the item's number of shingles) and whether the shingle is one of the item's minima."""
    each = (_shingled(items, "item_id").select("item_id", F.explode("shingles").alias("shingle")).distinct())
    by_item = Window.partitionBy("item_id")
    common = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("items")), "shingle")
    sized = common.withColumn("q", F.count(F.lit(1)).over(by_item)).withColumn(
        "rank", F.row_number().over(by_item.orderBy("items", F.xxhash64("shingle", F.lit(1)), "shingle")))
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("q").cast("double")))).cast("long")
    minima = F.floor(size_class * (UNDER - OVER) / UNDER) + 1
    return sized.select("item_id", "shingle", "q", (F.col("rank") <= minima).alias("minimum"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, q, containment of every document and item at 80 % or more."""
    inside = stored(item_shingles(items), "item-shingles")
    n = inside.count()
    wanted = inside.select("shingle").distinct()
    found = stored(
        _shingled(docs, "doc_id")
        .select("doc_id", F.explode("shingles").alias("shingle"))
        .join(_sent(wanted, n), "shingle").distinct(), "shared-shingles")
    minima = inside.where("minimum").select("item_id", "shingle", "q")
    enough = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held"))  # of all rows of an id together
    candidates = (found.join(_sent(minima, n), "shingle").select("doc_id", "item_id", "q").distinct()
                  .join(enough, "doc_id").where(F.col("held") * UNDER >= F.col("q") * OVER)
                  .select("doc_id", "item_id"))
    asked = candidates.join(_sent(inside.select("item_id", "shingle", "q"), n), "item_id")
    held = asked.join(found.select("doc_id", "shingle"), ["doc_id", "shingle"])
    counted = held.groupBy("doc_id", "item_id", "q").agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(F.col("shared") * UNDER >= F.col("q") * OVER).select(
        "doc_id", "item_id", "shared", "q", F.round(F.col("shared") / F.col("q"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; an id with a contaminated row goes with all its rows."""
    dirty = stored(matches(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As ``clean``, but a row without an id is searched too, by a key of its own text, and goes if it holds an item."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"))
    dirty = stored(matches(docs.select(key.alias("doc_id"), "text"), items).select(
        F.col("doc_id.none").alias("_none"), F.col("doc_id.id").alias("_id")).distinct(), "contaminated")
    return docs.join(dirty, (key["none"] == dirty["_none"]) & (key["id"] == dirty["_id"]), "left_anti").select(*docs.columns)


#: The same result by brute force.
SQL = r"""
WITH split AS MATERIALIZED (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')
  FROM benchmark WHERE item_id IS NOT NULL),
word AS (SELECT side, id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM split),
run AS (
  SELECT side, id, i, n, string_agg(t, ' ') OVER (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s
  FROM word),
shingle AS MATERIALIZED (SELECT DISTINCT side, id, s FROM run WHERE i = 1 OR i <= n - 4),
item AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS q FROM shingle WHERE side = 1),
pair AS (
  SELECT d.id AS doc_id, i.id AS item_id, i.q AS q, count(*) AS shared
  FROM shingle d JOIN item i ON d.s = i.s WHERE d.side = 0 GROUP BY ALL)
SELECT doc_id, item_id, shared, q, round(shared / q, 6) AS containment FROM pair WHERE shared * 5 >= q * 4
"""
