"""Near-duplicates by SimHash, searched with deletion variants.

A fingerprint has 64 bits; a bit is 1 where it is set in more than half of the hashes of a text's word shingles (repeats
count). Two fingerprints are linked if they differ in at most ``REACH`` = 3 bits. Cut in two halves, at least one half
then differs in one bit at most, so two halves are enough where exact segments would need four:

1. Texts with one fingerprint are one class, and the halves of the classes are counted by value before anything else.
2. The one-wildcard variants of the different half values (one for each deleted bit) are an index: values that share
   a variant are equal or one bit apart. An equality join on variants meets two values at most, however many
   documents have them.
3. A *cell* holds the fingerprints with one half value, or with two neighbouring ones. All linked pairs meet in a cell.
   A cell of up to ``CELL`` fingerprints is compared whole, and names a spanning forest of its links, not its pairs.
4. Larger cells are cut again by the same rule: two pieces of the other half, at 16 and then at 8 bits, each with its
   one-wildcard variants. As fingerprints of a cell are all different and agree in all but 11 bits by then, the last
   cells have 2,048 members at most. No cell is cut off or left out.
5. Components of the links, as stars over classes.

Nulls and edges: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle
are one shingle; null ids count as rows, and a component's id is its least id that is not null; repeated rows get equal
answers; an empty table gives an empty result; other columns are not read. Long texts are read in pieces, never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrays import pieces
from .components import components
from .order import stored

WORDS, SEED, REACH = 3, 42, 3
CELL = 1024
VARIANTS = 500_000  # in one task
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(raw: bytes, n: int = WORDS) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    size, held, tail = 0, np.zeros(64, np.int64), []
    for piece in pieces(raw, _GAP):
        words = tail + piece.lower().split()  # for bytes: A-Z, and the six ASCII white spaces
        if len(words) >= n:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            said = b" ".join(words)
            h = [xxhash.xxh64_intdigest(said[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1:].tolist())]
            size += len(h)
            held += _bits(h)
        tail = words[1 - n:] if n > 1 else []
    if not size and tail:
        size, held = 1, _bits([xxhash.xxh64_intdigest(b" ".join(tail), SEED)])
    return sum(1 << k for k in np.flatnonzero(2 * held > size).tolist())


def _bits(h: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"")
                              for t in batch.column(1).cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that hang the linked fingerprints of a cell together: one less than each component has."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= REACH
    label = np.arange(len(fps), dtype=np.int32)
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def _compared(cells: DataFrame) -> DataFrame:
    """Links a, b of the cells (``fps``: their members)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            at, fp = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            twos = at[:-1][np.diff(at) == 2]
            twos = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= REACH]
            a, b = [fp[twos]], [fp[twos + 1]]
            for k in np.flatnonzero(np.diff(at) > 2):
                own = fp[at[k]:at[k + 1]]
                x, y = spanning(own)
                a.append(own[x])
                b.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])
    return cells.select("fps").mapInArrow(run, "a long, b long")


def _gathered(members: DataFrame) -> DataFrame:
    return members.groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)


def _cut(members: DataFrame, width: int) -> DataFrame:
    """Members dealt to the cells of the next level: ``free`` bits (twice the width) in two pieces, one deleted bit each.

    ``free`` of the result is the other piece.
    """
    mask = (1 << width) - 1
    variants = members.select("cell", "fp", F.inline(F.expr(
        f"array(struct(0 AS side, free & {mask}L AS own, shiftrightunsigned(free, {width}) AS other), "
        f"struct(1 AS side, shiftrightunsigned(free, {width}) AS own, free & {mask}L AS other))")))
    variants = variants.select("cell", "fp", "side", "own", "other", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
    return variants.select(F.xxhash64("cell", "side", "bit", F.expr("own & ~shiftleft(1L, bit)")).alias("cell"), "fp",
                           F.col("other").alias("free"))


def links(classes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links a, b that join all the different fingerprints ``fp`` that differ in at most three bits."""
    halves = classes.select("fp", F.inline(F.expr(
        "array(struct(0L AS side, fp & 4294967295L AS own, shiftrightunsigned(fp, 32) AS other), "
        "struct(1L AS side, shiftrightunsigned(fp, 32) AS own, fp & 4294967295L AS other))")))
    values = stored(halves.groupBy("side", "own").agg(F.count(F.lit(1)).alias("n")), "half-values")
    spread = values.repartition(max(1, -(-32 * values.count() // VARIANTS)))  # the table is small, its variants are not
    # The index: a variant is named by side and deleted bit (above) and the rest of the value (32 bits below).
    variants = spread.select("own", "n", F.col("side"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).select(
        F.expr("shiftleft(side * 32 + bit, 32) | (own & ~shiftleft(1L, bit))").alias("cell"),
        F.expr("IF(shiftrightunsigned(own, bit) & 1 = 0, n, 0)").alias("n0"),
        F.expr("IF(shiftrightunsigned(own, bit) & 1 = 1, n, 0)").alias("n1"))
    near = variants.groupBy("cell").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1")).where("n0 > 0 AND n1 > 0").select(
        "cell", (F.col("n0") + F.col("n1")).alias("size"), F.expr("shiftrightunsigned(cell, 37)").alias("side"),
        F.expr("cell & 4294967295L").alias("low"), F.expr("shiftleft(1L, CAST(shiftrightunsigned(cell, 32) & 31 AS INT))").alias("bit"))
    cells = near.select("cell", "size", "side", F.explode(F.expr("array(low, low | bit)")).alias("own")).unionByName(
        values.where("n > 1").select(F.expr("shiftleft(64 + side, 32) | own").alias("cell"), F.col("n").alias("size"), "side", "own"))
    members = stored(halves.join(stored(cells, "cells"), ["side", "own"]).select("cell", "size", "fp", F.col("other").alias("free")), "members")
    found = _compared(_gathered(members.where(F.col("size") <= cell)))
    large = members.where(F.col("size") > cell)
    if not large.isEmpty():
        parts = stored(_cut(large, 16), "cut-cells")
        sizes = stored(parts.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cut-sizes")
        parts = stored(parts.join(sizes, "cell"), "cut-members")
        found = found.unionByName(_compared(_gathered(parts.where(F.col("size") <= cell))))
        found = found.unionByName(_compared(_gathered(_cut(parts.where(F.col("size") > cell), 8))))
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least id reachable); one row for each row of ``docs``."""
    known = stored(fingerprints(docs), "fingerprints")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(stored(links(classes), "links"))
    placed = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = stored(placed.join(least, "root").select("fp", "component_id"), "by-class")
    return known.join(by_class, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
