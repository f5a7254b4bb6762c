"""Near-duplicates by b-bit MinHash.

A document is the set of its word shingles, as 64-bit hashes. Of each of ``K`` minima only the ``B`` low bits are
kept; packed signatures of two documents are compared by counting equal places, and the count is corrected for chance
agreement (``2**-B``) to an estimate of the similarity. Candidates come from bands: documents that agree in all minima
of one band. The chance that a pair at similarity 0.8 shares no band is 3e-6 (2e-9 at 0.85).

1. One pass over the texts gives set size, set digest, packed signature and band keys. Documents with equal sets are
   one class from here on, whatever their number.
2. In each band bucket, every class is paired with one hub, the class with the most companions over all its buckets
   (of a family of copies that is its original, or near to it): a star, not all pairs.
3. Pairs whose estimate is more than six standard deviations below the threshold go; the others are confirmed on the
   full sets, built again for candidate documents only.
4. Buckets whose classes do not yet hang together are compared in full: the classes of all such buckets with one hub
   form a group, and its largest component is compared with the others in blocks of bounded size. Pairs go first by an
   exact bound (both sides lose the shingles that no other such class has), then by the estimate; the rest is counted
   on the full sets in the block, which names only links that join something new. No pair that shares a bucket is left
   out unless it cannot be similar enough or its ends are already linked.
5. Components of the confirmed links, as stars over classes.

Nulls and edges: a null or wordless text has an empty set and is linked with nothing; a text with fewer words than a
shingle is one shingle; null ids are ids like others when rows are counted, and the component id is the least id that
is not null; repeated rows are one class; an empty table gives an empty result; other columns are only passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .components import components
from .order import stored

B = 2
ROWS, BANDS = 6, 42
K = ROWS * BANDS
BLOCK = 192
_RNG = np.random.default_rng(20_240_301)
_A = _RNG.integers(1, 2**32, K, dtype=np.uint32) | np.uint32(1)
_C = _RNG.integers(0, 2**32, K, dtype=np.uint32)
_POWER = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


@dataclass(frozen=True)
class Links:
    """Shingle size in words, and the least similarity as a ratio of whole numbers."""
    words: int = 5
    over: int = 80
    under: int = 100

    @property
    def least(self) -> float:
        """Estimates below this are at least six standard deviations under the threshold."""
        j = self.over / self.under
        chance = 2.0**-B
        p = chance + (1 - chance) * j
        return j - 6 * (p * (1 - p) / K) ** 0.5 / (1 - chance)


def minima(shingle: np.ndarray) -> np.ndarray:
    """The least value of each of K hash functions over a non-empty set."""
    low = (shingle >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        np.minimum(out, (low[k:k + 512, None] * _A + _C).min(axis=0), out=out)
    return out


def pack(least: np.ndarray) -> bytes:
    """The B low bits of the (mixed) minima, eight to a byte."""
    low = (least ^ (least >> np.uint32(15))) & np.uint32((1 << B) - 1)
    return np.packbits(((low[:, None] >> np.arange(B, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = arrays.mix(least.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1))
    return arrays.mix((rows * _POWER).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of packed signatures (last axis: bytes), corrected for chance agreement."""
    x = a ^ b
    differ = x | (x >> 1)  # B = 2: a place differs if either of its bits does
    unequal = _ONES[differ & 0x55].sum(axis=-1, dtype=np.int64)
    chance = 2.0**-B
    return (1 - unequal / K - chance) / (1 - chance)


def sets(at: np.ndarray, data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each document."""
    word, first = arrays.words(at, data)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(arrays.shingles(word[a:b], n))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


SKETCH = "doc_id long, text_key long, n_shingles long, class binary, signature binary, bands array<long>"


def sketches(docs: DataFrame, rule: Links) -> DataFrame:
    """Set size, class digest, packed signature and band keys of every document; nulls for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                size, digest, packed, keys = [], [], [], []
                for s in sets(at, data, rule.words):
                    size.append(len(s))
                    if len(s):
                        least = minima(s)
                        digest.append(_digest(s))
                        packed.append(pack(least))
                        keys.append(band_keys(least))
                    else:
                        for out in (digest, packed, keys):
                            out.append(None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_shingles", "class", "signature", "bands"])
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SKETCH)


PAIR = "a binary, b binary"


def _likely(pairs: DataFrame, rule: Links) -> DataFrame:
    """Pairs (a, b, and their signatures and sizes) that the estimate and the sizes allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y) >= rule.least))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    fits = pairs.where(small * rule.under >= large * rule.over)
    return fits.select("a", "b", "sa", "sb").mapInArrow(run, PAIR)


def full_sets(wanted: DataFrame, docs: DataFrame, rule: Links) -> DataFrame:
    """class and shingles of the classes in ``wanted`` (class, doc_id: one of its documents).

    Texts of other documents are left behind in the scan by a bit table of
    bounded size over the ids wanted (false positives only cost time; the join is exact).
    """
    table = _bits(wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(table.has(batch.column(0))))
            for part, at, data in arrays.runs(batch):
                found = list(sets(at, data, rule.words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_digest(s) for s in found], pa.binary()),
                     pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["doc_id", "class", "shingles"])
    built = (docs.select(F.col("doc_id").cast("long"), "text")
             .mapInArrow(build, "doc_id long, class binary, shingles array<long>"))
    one = built.join(wanted.select("class", F.col("doc_id").alias("_w")), "class").where(
        F.col("doc_id").eqNullSafe(F.col("_w"))).select("class", "shingles").dropDuplicates(["class"])
    return stored(one, "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, rule: Links) -> DataFrame:
    """The pairs that hold on their full sets."""
    left = pairs.join(full.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(full.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    held = both.where(shared.cast("long") * rule.under >= union.cast("long") * rule.over).select("a", "b").distinct()
    return stored(held, "links")


#: Least and largest size of a bit table, as powers of two: 1 MB to 32 MB.
TABLE_BITS = (23, 28)


@dataclass(frozen=True)
class Bits:
    """A bit table over ids: sixteen bits for each id, in all at least 1 MB and at most 32 MB.

    Ids that were put in are always found. Of others few are found, below some 10**8
    ids; beyond, more are, which costs time but no result, as exact joins follow.
    """
    power: int
    table: np.ndarray

    @staticmethod
    def place(ids: pa.Array, power: int) -> np.ndarray:
        return (arrays.mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - power)).astype(np.int64)

    def has(self, ids: pa.Array) -> np.ndarray:
        at = self.place(ids, self.power)
        return (self.table[at >> 3] >> (at & 7)) & 1 == 1


def _bits(wanted: DataFrame) -> Bits:
    """The table of the ids in ``wanted``, a written table; filled in the tasks, 64 bits a row come to the driver."""
    power = min(max((16 * wanted.count()).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Bits.place(batch.column(0), power)
            word, back = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])
    found = (wanted.select(F.col("doc_id").cast("long")).mapInArrow(run, "word long, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    words = np.zeros(1 << power >> 6, "<i8")
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return Bits(power, words.view(np.uint8))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(both), 4096):
        part = both[k:k + 4096]
        x, y = (np.stack([np.isin(part, s, assume_unique=True) for s in side]).astype(np.float32) for side in (left, right))
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def _joined(square: pa.Table, rule: Links) -> pa.Table:
    """The links between two blocks of classes (or inside one) that join different components."""
    own, n, u = (square.column(c).to_numpy() for c in ("own", "n", "own_only"))
    packed = np.frombuffer(b"".join(square.column("signature").to_pylist()), np.uint8).reshape(square.num_rows, -1)
    root = np.unique(np.array(square.column("root").to_pylist(), object), return_inverse=True)[1]
    i, j = square.column("i")[0].as_py(), square.column("j")[0].as_py()
    x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
    a, b = [], []
    if len(x) and len(y):
        most = np.minimum((n - u)[x][:, None], (n - u)[y][None, :])  # shingles that the two can share
        total = n[x][:, None] + n[y][None, :]
        maybe = (root[x][:, None] != root[y][None, :]) & (most * rule.under >= (total - most) * rule.over)
        for k in np.flatnonzero(maybe.any(axis=1)):
            maybe[k] &= estimate(packed[x[k]], packed[y]) >= rule.least
        x, y, maybe, total = (v for v in (x[maybe.any(axis=1)], y[maybe.any(axis=0)],
                                          maybe[maybe.any(axis=1)][:, maybe.any(axis=0)],
                                          total[maybe.any(axis=1)][:, maybe.any(axis=0)]))
    if len(x) and len(y):
        held = square.column("shingles").combine_chunks()
        sets_ = {k: held[int(k)].values.to_numpy() for k in {*x.tolist(), *y.tolist()}}
        both = _shared([sets_[k] for k in x.tolist()], [sets_[k] for k in y.tolist()])
        name = square.column("class").to_pylist()
        up = list(range(int(root.max()) + 1))

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r
        for p, q in zip(*np.nonzero(maybe & (both * rule.under >= (total - both) * rule.over))):
            s, t = top(int(root[x[p]])), top(int(root[y[q]]))
            if s != t:
                up[s] = t
                lo, hi = sorted((name[x[p]], name[y[q]]))
                a.append(hi)
                b.append(lo)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _rest(members: DataFrame, facts: DataFrame, rule: Links) -> DataFrame:
    """Links between different components inside the groups of ``members`` (hub, class, root).

    ``facts`` (class, signature, n, own_only, shingles) has the classes that can have a link at all.
    """
    alive = stored(members.join(facts.select("class"), "class"), "alive")
    sizes = alive.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.groupBy("hub").agg(F.max(F.struct("size", "root")).alias("largest"), F.sum("size").alias("total"))
    groups = groups.where("total > largest.size").select(
        "hub", F.col("largest.root").alias("main"), F.ceil((F.col("total") - F.col("largest.size")) / BLOCK).alias("others"),
        F.ceil(F.col("largest.size") / BLOCK).alias("mains"))
    placed = alive.join(stored(groups, "groups"), "hub")
    # Blocks 0 .. others-1 hold the other components, the following ones the main component, which need not meet itself.
    at, apart = F.xxhash64("class"), F.col("root") != F.col("main")
    own = F.when(apart, F.pmod(at, F.col("others"))).otherwise(F.col("others") + F.pmod(at, F.col("mains")))
    meets = F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(apart, F.col("mains")).otherwise(F.lit(0)) - 1)
    squares = placed.select("hub", "class", "root", own.alias("own"), F.explode(meets).alias("other")).select(
        "hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "root")
    return squares.join(facts, "class").groupBy("hub", "i", "j").applyInArrow(lambda t: _joined(t, rule), PAIR).distinct()


def _resolved(docs: DataFrame, rule: Links) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and of every class its component's least id and its own, and whether it stays for them all.

    Of a component the class with the least id stays, of several such the one with the least digest.
    """
    known = stored(sketches(docs, rule), "sketches")
    classes = stored(known.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands")), "classes")
    # Buckets with company, and in each the class that has most company.
    bands = classes.select(F.explode("bands").alias("key"), "class")
    shared = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-keys")
    buckets = stored(bands.join(shared, "key"), "buckets")
    company = buckets.groupBy("class").agg(F.sum("size").alias("company"))
    hubs = stored(buckets.join(company, "class").groupBy("key").agg(
        F.max(F.struct("company", "class")).alias("hub")).select("key", F.col("hub.class").alias("b")), "hubs")
    star = buckets.join(hubs, "key").where("class != b").select(F.col("class").alias("a"), "b").distinct()

    facts = classes.select("class", "doc_id", "signature", "n")
    ends = star
    for end in ("a", "b"):
        ends = ends.join(facts.select(F.col("class").alias(end), F.col("signature").alias(f"s{end}"),
                                      F.col("n").alias(f"n{end}")), end)
    likely = stored(_likely(ends, rule), "likely")
    wanted = stored(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct()
                    .join(facts.select("class", "doc_id"), "class"), "wanted")
    sure = _confirmed(likely, full_sets(wanted, docs, rule), rule)

    # Buckets that hold several components still, all those with one hub together.
    roots = components(sure)
    placed = stored(buckets.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "key", "class", F.coalesce("root", "class").alias("root")), "placed")
    several = (placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
               .join(hubs, "key").select("key", F.col("b").alias("hub")))
    members = stored(placed.join(stored(several, "several"), "key").select("hub", "class", "root").distinct(), "members")
    open_ = stored(members.select("class").distinct().join(facts, "class"), "open")
    sets_ = full_sets(open_.select("class", "doc_id"), docs, rule)
    each = sets_.select("class", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("class").alias("class")).where("held = 1")
    u = alone.groupBy("class").agg(F.count(F.lit(1)).alias("own_only"))
    bounded = stored(open_.join(u, "class", "left").select(
        "class", "signature", "n", F.coalesce("own_only", F.lit(0)).alias("own_only"))
        .where((F.col("n") - F.col("own_only")) * rule.under >= F.col("n") * rule.over).join(sets_, "class"), "bounded")
    rest = stored(_rest(members, bounded, rule), "rest")
    if not rest.isEmpty():
        sure = sure.unionByName(rest)
        roots = components(sure)

    ids = stored(classes.select("class", F.col("doc_id").alias("least"))
                 .join(roots.withColumnRenamed("node", "class"), "class", "left")
                 .withColumn("root", F.coalesce("root", "class")), "roots")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(
        F.col("least").isNull().alias("none"), F.col("least"), F.col("class").alias("stays"))).alias("first"))
    by_class = ids.join(least, "root").select(
        "class", "component_id", "least", (F.col("class") == F.col("first.stays")).alias("stays"))
    return known, stored(by_class, "by-class")


def near_duplicates(docs: DataFrame, rule: Links = Links()) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the component), kept; one row for each row of ``docs``."""
    known, by_class = _resolved(docs, rule)
    out = known.select("doc_id", "n_shingles", "class").join(by_class.select("class", "component_id"), "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, rule: Links = Links()) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the least id; repeated rows once.

    It is decided for an id and a text together: different documents that
    share an id, or have none, go only for a document that they are linked with.

    Most documents stay, and their texts are not moved: a bit table of bounded
    size over the ids that may go leaves only their rows to an exact join
    (false positives only cost time).
    """
    known, by_class = _resolved(docs, rule)
    result = stored(known.select("doc_id", "text_key", "class").join(by_class, "class", "left").select(
        "doc_id", "text_key", "class", (F.col("class").isNull() | (
            F.col("stays") & F.col("doc_id").eqNullSafe(F.col("least")))).alias("kept")), "kept")
    doubtful = stored(result.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                      .where("n > 1 or not kept").select("doc_id"), "doubtful")
    table = _bits(doubtful)

    @F.arrow_udf("boolean")
    def marked(ids: pa.Array) -> pa.Array:
        return pa.array(table.has(ids))
    split = marked(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")))
    kept = result.where("kept").where(split).select(
        F.col("doc_id").alias("_kept"), F.col("text_key").alias("_key"), F.col("class").alias("_class")).distinct()
    rows = docs.where(split)
    # A class stays with one row for its id; texts without words are linked with nothing, so only equal ones are one.
    checked = (rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & (F.xxhash64(rows["text"]) == kept["_key"]))
               .withColumn("_text", F.when(F.col("_class").isNull(), F.col("text")))
               .dropDuplicates(["doc_id", "_class", "_text"]).select(*docs.columns))
    return docs.where(~split).unionByName(checked)


#: The registered query (three words, 85 %) by brute force.
SQL = r"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM split),
run AS (
  SELECT doc_id, i, n, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s
  FROM word),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM run WHERE i = 1 OR i <= n - 2),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM split d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""
