"""Chat formatting after cumulative-snapshot collapse.

A log often holds the same conversation several times, each time with more turns. Every turn gets a hash of the
conversation up to it: the exclusive-or, over all turns so far, of two 64-bit hashes of (position, role, text). Two
prefixes of equal length are equal exactly when these 128 bits agree. A conversation goes when its whole hash is the
hash of a proper prefix of another one (anti-join); of equal conversations the least id stays. The rest is rendered.

Turns are sorted over range partitions, and running hashes are carried over the stretches of a conversation in each
partition by their totals, so one long conversation, or all turns without an id or a number, do not meet in one task. A rendered conversation comes in parts of at most
``PART`` turns for the same reason. Texts travel only to their rendering.

Nulls and edges: a null role is ``unknown``, a null text is empty, null turns come first, null ids are one
conversation; a turn logged twice in full counts once; different rows with one turn number follow in the order of
their hashes; control marks inside a text or a role are defused; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .order import sorted_parts, stored

PART = 4096
_NO_ID = -(2**63)
#: Fixed values of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(logs: DataFrame) -> DataFrame:
    return logs.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "text", "role")})


def prefix_hashes(logs: DataFrame) -> DataFrame:
    """conv_id, turn, h, g, position (from 1) and the two prefix hashes of each different turn."""
    each = _turns(logs).select("conv_id", "turn", "h", "g").distinct()
    each = stored(sorted_parts(each, "conv_id", "turn", "h", "g"), "sorted-turns").withColumnsRenamed({"_part": "span", "_at": "at"})
    inside = Window.partitionBy("conv_id", "span").orderBy("at")
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("place", F.row_number().over(inside))
    before = ranked.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = stored(ranked.join(before, ["conv_id", "span"]).withColumn("position", F.col("place") + F.col("before"))
                    .withColumns({"p": F.xxhash64("position", "h", "g"), "q": F.xxhash64("g", "h", "position")})
                    .drop("place", "before"), "turns")
    running = placed.withColumns({c: F.expr(f"bit_xor({c})").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in ("p", "q")})
    totals = placed.groupBy("conv_id", "span").agg(F.expr("bit_xor(p)").alias("p"), F.expr("bit_xor(q)").alias("q"))
    carried = totals.select("conv_id", "span", *(
        F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(f"{c}0") for c in ("p", "q")))
    return running.join(carried, ["conv_id", "span"]).select(
        "conv_id", "turn", "h", "g", "position", F.col("p").bitwiseXOR(F.col("p0")).alias("p"),
        F.col("q").bitwiseXOR(F.col("q0")).alias("q"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no proper prefix of another one."""
    whole = (prefixes.groupBy("conv_id").agg(F.max(F.struct("position", "p", "q")).alias("last"))
             .select("conv_id", "last.*"))
    different = whole.groupBy("position", "p", "q").agg(F.min("conv_id").alias("conv_id"),
                                                        F.count(F.lit(1)).alias("n_copies"))
    proper = (prefixes.join(whole.select("conv_id", F.col("position").alias("n")), "conv_id")
              .where("position < n").select("position", "p", "q").distinct())
    return different.join(proper, ["position", "p", "q"], "left_anti").select(
        "conv_id", F.col("position").alias("n_turns"), "n_copies")


def render(logs: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies and text of every maximal conversation."""
    prefixes = stored(prefix_hashes(logs), "prefixes")
    chosen = stored(maximal(prefixes), "maximal")
    places = prefixes.select("conv_id", F.col("turn").alias("_turn"), "h", "g", "position").join(chosen, "conv_id")
    texts = _turns(logs).dropDuplicates(["conv_id", "turn", "h", "g"]).join(places, ["conv_id", "h", "g"]).where(
        F.col("turn").eqNullSafe(F.col("_turn")))
    role, text = (F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<|$1 |>") for c in ("role", "text"))
    shown = F.concat(F.lit(OPEN), F.translate(role, "\r\n", "  "), F.lit("\n"), text, F.lit(CLOSE + "\n"))
    parts = texts.groupBy("conv_id", F.floor((F.col("position") - 1) / PART).cast("int").alias("part"),
                          "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("position", shown.alias("shown")))).alias("turns"))
    return parts.select(F.nullif("conv_id", F.lit(_NO_ID)).alias("conv_id"), "part",
                        F.col("n_turns").cast("long").alias("n_turns"), "n_copies",
                        F.array_join("turns.shown", "").alias("text"))


#: The same result by comparing whole texts (for conversations of one part, with turn numbers used once).
SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
u AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
         '<|im_start|>' || translate(regexp_replace(role, '<\|(im_start|im_end)\|>', '<|\1 |>', 'g'), chr(13) || chr(10), '  ') || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '<|\1 |>', 'g') || '<|im_end|>' || chr(10) AS shown,
         role || chr(1) || text || chr(2) AS raw
  FROM t),
prefix AS (
  SELECT conv_id, position, string_agg(raw, '') OVER (PARTITION BY conv_id ORDER BY position) AS said,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM u),
whole AS (SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefix WHERE position = n_turns GROUP BY ALL),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefix p WHERE p.said = w.said AND p.position < p.n_turns))
SELECT k.conv_id, CAST(0 AS INTEGER) AS part, k.n_turns, k.n_copies, string_agg(u.shown, '' ORDER BY u.position) AS text
FROM kept k JOIN u ON u.conv_id = k.conv_id GROUP BY ALL
"""
