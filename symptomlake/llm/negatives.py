"""Hard negatives by exact integer scores from a residue-number-system matrix product.

A component ``x`` becomes the whole number ``floor(scale * x)``. Scores are inner products of whole numbers, so they must
be exact. A float32 product is, below 2**24: the component matrices are taken modulo several small primes, with
residues around zero, multiplied as float32 (long vectors in stretches of ``DIMS``), and each product is reduced again.
Chinese remaindering (balanced mixed radix digits) puts the signed score together. As many primes are taken as the
largest score can need, which the longest vector and the largest component bound; a score is a 64-bit number.

Every row whose id is divisible by ``anchor`` is an anchor, and meets all rows, in blocks: anchors and rows are dealt to
blocks of about ``BLOCK`` by a hash, and each pair of blocks is one group, so no task holds more than two blocks. In a
group, rows are sorted by id, so a stable sort by score breaks ties. A block names for each anchor only what it can add
to the result; a window over these picks the best of all blocks, cut on the map side first. This is done twice: for
positives (only rows of the anchor's label are multiplied), then, with each positive's score as a window of allowed
scores, for negatives (only the rows of other labels).

Nulls and edges: rows with a null label or vector, or with a component that is null, not finite, or not finite once it
is scaled, take no part; a null id is no anchor, and as a positive or negative comes after other ids at a tie; shorter
vectors count as filled up with zeros, and an empty one scores 0; repeated rows are rows of their own, and only the
very row is not its own positive; a positive score below zero has no negatives, as its window is empty; an empty table
gives an empty result; other columns are not read. Scores beyond 64 bits have no value in a long column and are wrapped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .order import stored

DIMS, BLOCK, TILE = 4096, 8192, 256
LAST = 2**63 - 1  # stands for a null id, which comes after all others


@dataclass(frozen=True)
class Mining:
    """Which rows are anchors, how many positives and negatives they get, and the allowed share of a positive's score."""
    anchor: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent
    high: int = 95
    scale: int = 256


def primes_for(dims: int, largest: int) -> list[int]:
    """Odd primes, from the largest whose float32 products are exact, until every score of that size has one residue tuple."""
    half = int(((2**24 - 1) / max(1, min(dims, DIMS))) ** 0.5)
    need = 2 * min(dims * largest * largest, 2**63) + 1
    out, product, p = [], 1, 2 * half + 1
    while product <= need and p > 2:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """A matrix of whole numbers (as float64) modulo each prime, around zero, as float32."""
    out = []
    for p in primes:
        r = np.fmod(x, p)
        out.append((r - p * np.rint(r / p)).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of the rows of two matrices, given by their residues."""
    digits: list[np.ndarray] = []
    total, weight = None, 1
    for k, p in enumerate(primes):
        t = np.zeros((len(left[k]), len(right[k])), np.int64)
        for d in range(0, left[k].shape[1], DIMS):
            t += np.fmod(left[k][:, d:d + DIMS] @ right[k][:, d:d + DIMS].T, np.float32(p)).astype(np.int64)
        for q, v in zip(primes, digits):
            t -= v
            t *= pow(q, -1, p)
            t %= p
        t %= p
        t -= p * (t > p // 2)
        digits.append(t)
        part = t * np.uint64(weight % 2**64).astype(np.int64)  # wraps as 64-bit numbers do
        total = part if total is None else total + part
        weight *= p
    return np.zeros((len(left[0]), len(right[0])), np.int64) if total is None else total


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers, shorter ones filled up with zeros."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)] = flat[at[0]:at[-1]]
    return out


def vectors(rows: DataFrame, noisy: bool = False, rule: Mining = Mining()) -> DataFrame:
    """row (a number of its own), vec_id, label and the whole components ``v`` of the rows that take part."""
    label = F.col("label").cast("long")
    if noisy:  # a wrong label on some rows
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(rule.scale))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col("vec_id").cast("long"), label.alias("label"), v.alias("v")).where("label IS NOT NULL AND v IS NOT NULL")
    # floor() gives a long; beyond 2**52 every double is whole.
    found = found.where(whole).withColumn("v", F.transform("v", lambda x: F.when(
        F.abs(x) < float(2**52), F.floor(x).cast("double")).otherwise(x)))
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _grid(rows: DataFrame, anchors: DataFrame, extra: str) -> DataFrame:
    """Every pair of an anchor block (i) and a row block (j); ``extra`` is a column that anchors alone have."""
    n_rows, n_anchors = max(1, -(-rows.count() // BLOCK)), max(1, -(-anchors.count() // BLOCK))
    kind = dict(anchors.dtypes)[extra]
    def dealt(df, own, n, other, m, mark):
        return df.select(F.pmod(F.xxhash64("row"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other),
                         F.lit(mark).alias("anchor"), "row", F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "label", "v",
                         F.col(extra) if mark else F.lit(None).cast(kind).alias(extra))
    return dealt(rows, "j", n_rows, "i", n_anchors, False).unionByName(dealt(anchors, "i", n_anchors, "j", n_rows, True))


def _tiles(group: pa.Table, primes: list[int], dims: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of anchors, places of rows, their scores) for the pairs of one label, or of different labels.

    Rows come by id and then by their own number.
    """
    held = group.combine_chunks()
    anchor, label = (held.column(c).to_numpy() for c in ("anchor", "label"))
    by_id = np.lexsort((held.column("row").to_numpy(), held.column("vec_id").to_numpy()))
    lists = held.column("v").chunk(0) if held.num_rows else pa.array([], pa.list_(pa.float64()))
    whole = residues(matrix(lists, dims), primes)
    for own in np.unique(label[anchor]):
        a = np.flatnonzero(anchor & (label == own))
        r = by_id[~anchor[by_id] & ((label[by_id] == own) == same)]
        right = [x[r] for x in whole]
        for k in range(0, len(a) if len(r) else 0, TILE):
            yield a[k:k + TILE], r, scores([x[a[k:k + TILE]] for x in whole], right, primes)


def _size(rows: DataFrame) -> tuple[int, list[int]]:
    """Longest vector and the primes it takes."""
    found = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims = found[0] or 0
    return dims, primes_for(dims, int(found[1] or 0))


FOUND = "of long, nth int, row long, vec_id long, score long"


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` of each ``keys``, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positives(rows: DataFrame, anchors: DataFrame, rule: Mining, dims: int, primes: list[int]) -> DataFrame:
    """of (an anchor's row), rank, vec_id and score of each anchor's best rows of its own label."""
    def run(group: pa.Table) -> pa.Table:
        row, ids = (group.column(c).to_numpy() for c in ("row", "vec_id"))
        out = [[], [], [], []]
        for a, r, s in _tiles(group, primes, dims, same=True):
            for k, own in enumerate(a.tolist()):
                best = np.argsort(-s[k], kind="stable")[:rule.positives + 1]
                best = best[row[r[best]] != row[own]][:rule.positives]
                for to, values in zip(out, (np.full(len(best), row[own]), row[r[best]], ids[r[best]], s[k][best])):
                    to.append(values)
        of, rows_, id_, score = (np.concatenate([np.zeros(0, np.int64), *v]) for v in out)
        return pa.table({"of": of, "nth": np.zeros(len(of), np.int32), "row": rows_, "vec_id": id_, "score": score})
    found = _grid(rows, anchors.withColumn("aim", F.lit(None).cast("int")), "aim").groupBy("i", "j").applyInArrow(run, FOUND)
    return _best(found, ["of"], rule.positives)


def allowed(score: int, rule: Mining) -> tuple[int, int]:
    """The least and the greatest whole score n with low * score <= 100 * n <= high * score."""
    return -(-rule.low * score // 100), rule.high * score // 100


def negatives(rows: DataFrame, aims: DataFrame, rule: Mining, dims: int, primes: list[int]) -> DataFrame:
    """of, nth (the positive's rank), rank, vec_id and score of the best allowed rows of other labels.

    ``aims`` are the anchors with ``aim``: (nth, score) of their positives.
    """
    def run(group: pa.Table) -> pa.Table:
        row, ids, aim = group.column("row").to_numpy(), group.column("vec_id").to_numpy(), group.column("aim")
        out = [[], [], [], [], []]
        for a, r, s in _tiles(group, primes, dims, same=False):
            for k, own in enumerate(a.tolist()):
                windows = [(x["nth"], *allowed(x["score"], rule)) for x in aim[own].as_py()]
                near = np.flatnonzero((s[k] >= min(w[1] for w in windows)) & (s[k] <= max(w[2] for w in windows)))
                down = -s[k][near]
                order = np.argsort(down, kind="stable")
                near, down = near[order], down[order]
                for nth, low, high in windows:
                    first = np.searchsorted(down, -high, "left")
                    best = near[first:min(first + rule.negatives, np.searchsorted(down, -low, "right"))]
                    for to, values in zip(out, (np.full(len(best), row[own]), np.full(len(best), nth, np.int32), row[r[best]],
                                                ids[r[best]], s[k][best])):
                        to.append(values)
        of, nth, rows_, id_, score = (np.concatenate([np.zeros(0, np.int64), *v]) for v in out)
        return pa.table({"of": of, "nth": nth.astype(np.int32), "row": rows_, "vec_id": id_, "score": score})
    found = _grid(rows, aims, "aim").groupBy("i", "j").applyInArrow(run, FOUND)
    return _best(found, ["of", "nth"], rule.negatives)


def mine(rows: DataFrame, rule: Mining = Mining(), noisy: bool = False) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, over all rows with an embedding."""
    whole = vectors(rows, noisy, rule)
    dims, primes = _size(whole)
    anchors = whole.where(F.col("vec_id") % rule.anchor == 0)
    good = stored(positives(whole, anchors, rule, dims, primes), "positives")
    aims = good.groupBy("of").agg(F.collect_list(F.struct(F.col("rank").alias("nth"), "score")).alias("aim"))
    bad = negatives(whole, anchors.join(aims.withColumnRenamed("of", "row"), "row"), rule, dims, primes)
    known = good.select("of", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.join(known, ["of", "nth"]).join(anchors.select(F.col("row").alias("of"), F.col("vec_id").alias("anchor_id")), "of")
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("vec_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


#: The registered query, by brute force.
SQL = """
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vec a JOIN vec b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT * FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
