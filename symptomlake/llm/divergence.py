"""How far do the sources of a language differ in their words? An audit with exact whole-number arithmetic.

Terms are stretches of letters, of all signs outside ASCII too; only A-Z are lower-cased. A language keeps the terms that
at least ``LEAST`` of its documents hold.

1. The documents of each term are counted; each task adds up what it has read. Null language, source or text is ''.
2. The kept terms are sorted over all partitions, so each has a lexicographic ordinal, and cut into shards of about
   ``SHARD`` bytes. Each shard becomes a minimal acyclic transducer (``transducer``) in a task of its own. Terms that
   share their first eight bytes stay in one shard, so a text's term finds its shard by these.
3. All whole texts stream through the transducers, and each task sends one number for each of its sources and ordinals.
   Transducers are loaded ``GROUP`` bytes at a time, measured before; a vocabulary beyond that takes another pass over
   the texts for each such group, so memory is bounded at every size.
4. Smoothed shares p = 1 + floor(1e9 (count + 1) / (N + V)), and f = floor((p - q)^2 / q), in one pass over the terms.
   For pairs of sources, each task adds up one matrix of sources for each language it meets; the list of sources, which
   it needs for that, is the square root of the result in size. For terms, each task keeps the first ``TOP`` of each
   source, ties by ordinal, and the first of all tasks follow by rank.

Edges: a language without kept terms has pairs of value 0 and no terms; a source that is alone in its language has no
pairs; repeated rows, whatever their id, are documents of their own; an empty table gives an empty result; other columns
are not read. Long texts are read in pieces that cut no term.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays, transducer
from .order import part_offsets, sorted_parts, stored

LEAST, TOP = 3, 200
SHARD, GROUP = 1 << 20, 64 << 20
HELD_TERMS, HELD_BYTES = 300_000, 256 << 20
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
LETTER = np.zeros(256, np.uint8)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def document_terms(raw: bytes) -> set[bytes]:
    """The different terms of a text in UTF-8."""
    out: set[bytes] = set()
    for piece in arrays.pieces(raw, _GAP):
        out.update(_TERM.findall(piece.lower()))
    return out


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(named: DataFrame, least: int = LEAST) -> DataFrame:
    """lang and term of every term that enough documents of the language hold."""
    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, terms in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                                              pa.array(list(terms.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        read = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = text.as_buffer().to_pybytes()
                read += len(raw)
                held[lang].update(document_terms(raw))
                if read > HELD_BYTES or len(held[lang]) > HELD_TERMS:
                    yield from rows(held)
                    read = 0
        yield from rows(held)
    found = named.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def vocabulary(kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """lang, term, ordinal (from 0, by language and then by the bytes of the term) and the shard it lies in."""
    parts = stored(sorted_parts(kept.withColumn("bytes", F.octet_length("term") + 8), "lang", "term"), "sorted-terms")
    rows = part_offsets(parts, F.count(F.lit(1))).drop("_all")
    weight = part_offsets(parts, F.sum("bytes")).select("_part", F.col("_before").alias("_bytes"))
    placed = parts.join(rows, "_part").join(weight, "_part").select(
        "lang", "term", (F.col("_before") + F.col("_at")).alias("ordinal"),
        (F.col("_bytes") + F.sum("bytes").over(Window.partitionBy("_part").orderBy("_at"))).alias("upto"))
    alike = Window.partitionBy("lang", F.substring(F.encode("term", "utf-8"), 1, 8))
    return stored(placed.select("lang", "term", "ordinal", F.floor(F.min("upto").over(alike) / shard).alias("shard")), "vocabulary")


def transducers(vocab: DataFrame) -> DataFrame:
    """lang, base (the least ordinal), first (its leading eight bytes) and the packed transducer of each shard."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("ordinal")
        terms = [t.encode() for t in group.column("term").to_pylist()]
        return pa.table({"lang": group.column("lang")[:1], "base": group.column("ordinal")[:1], "first": pa.array([terms[0][:8]], pa.binary()),
                         "packed": pa.array([transducer.build(terms).packed()], pa.binary())})
    built = vocab.groupBy("lang", "shard").applyInArrow(run, "lang string, base long, first binary, packed binary")
    return stored(built, "transducers")


def _prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The leading eight bytes of each stretch as a number that sorts like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))[starts]
    return (eight & arrays.KEEP[np.minimum(ends - starts, 8)]).byteswap()


class _Counts:
    """Counts by group and ordinal; summed up again and again, handed out when there are many."""

    def __init__(self) -> None:
        self.keys, self.n, self.waiting = [], [], 0

    def add(self, group: np.ndarray, ordinal: np.ndarray) -> None:
        key, n = np.unique(group << 40 | ordinal, return_counts=True)
        self.keys.append(key)
        self.n.append(n)
        self.waiting += len(key)
        if self.waiting > 2_000_000:
            self._sum()

    def _sum(self) -> None:
        key = np.concatenate([np.zeros(0, np.int64), *self.keys])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([np.zeros(0, np.int64), *self.n])[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys, self.n, self.waiting = [key[first]], [np.add.reduceat(n, first) if len(key) else n], 0

    @property
    def many(self) -> bool:
        return len(self.keys) == 1 and len(self.keys[0]) > 1_000_000

    def rows(self) -> pa.RecordBatch:
        self._sum()
        key, n = self.keys[0], self.n[0]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(key & ((1 << 40) - 1)), pa.array((key >> 40).astype(np.int32)), pa.array(n)],
                                          ["ordinal", "g", "n"])


def recounted(named: DataFrame, built: DataFrame, groups: list, group: int = GROUP) -> DataFrame:
    """ordinal and held: (g, n), how often each group (``groups``: lang, source, g) has each kept term."""
    context = named.sparkSession.sparkContext
    bounds, size_ = [], 0
    for base, size in sorted(built.select("base", F.octet_length("packed")).collect()):  # one row for each shard
        if not bounds or size_ + size > group:
            bounds.append([base, base])
            size_ = 0
        bounds[-1][1] = base
        size_ += size
    numbers = context.broadcast({(r.lang, r.source): r.g for r in groups})
    out = None
    for low, high in bounds:
        loaded = context.broadcast(sorted((r.lang, r.base, bytes(r.first), bytes(r.packed)) for r in
                                          built.where(F.col("base").between(low, high)).collect()))

        def run(batches: Iterator[pa.RecordBatch], loaded=loaded) -> Iterator[pa.RecordBatch]:
            by_lang = defaultdict(list)
            for lang, base, first, packed in loaded.value:
                by_lang[lang].append((int.from_bytes(first.ljust(8, b"\0"), "big"), base, transducer.Transducer.unpacked(packed)))
            counts = _Counts()
            for batch in batches:
                for part, at, data in arrays.runs(batch):
                    low = arrays.LOWER[data]
                    starts, ends, first = arrays.split(at, LETTER[low])
                    row = np.repeat(np.arange(part.num_rows), np.diff(first))
                    langs, sources = (part.column(c).to_pylist() for c in (0, 1))
                    own = np.array([numbers.value[g] for g in zip(langs, sources)], np.int64)
                    for lang in by_lang.keys() & set(langs):
                        token = np.flatnonzero(np.array([x == lang for x in langs])[row])
                        shards = by_lang[lang]
                        of = np.searchsorted(np.array([s[0] for s in shards], np.uint64), _prefixes(low, starts[token], ends[token]), "right") - 1
                        for k in np.unique(of[of >= 0]).tolist():
                            here = token[of == k]
                            place = shards[k][2].places(low, starts[here], ends[here])
                            hit = place >= 0
                            counts.add(own[row[here[hit]]], shards[k][1] + place[hit])
                if counts.many:
                    yield counts.rows()
            yield counts.rows()
        found = named.mapInArrow(run, "ordinal long, g int, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return named.sparkSession.createDataFrame([], "ordinal long, held array<struct<g: int, n: long>>")
    # Dealt by ordinal once: what is summed by (ordinal, g) is there already when it is gathered by ordinal.
    summed = out.repartition("ordinal").groupBy("ordinal", "g").agg(F.sum("n").alias("n"))
    return stored(summed.groupBy("ordinal").agg(F.collect_list(F.struct("g", "n")).alias("held")), "recounted")


def shares(n: np.ndarray, under: np.ndarray) -> np.ndarray:
    """p of counts, exact also where the product leaves 64 bits."""
    if len(n) and int(n.max()) >= 9_000_000_000:
        return np.array([1 + 1_000_000_000 * (int(a) + 1) // int(b) for a, b in zip(*np.broadcast_arrays(n, under))], np.int64)
    return 1 + 1_000_000_000 * (n + 1) // under


class _First:
    """The first ``top`` (value descending, ordinal ascending) of each group."""

    def __init__(self, top: int) -> None:
        self.top, self.held, self.waiting = top, [], 0

    def add(self, g: np.ndarray, ordinal: np.ndarray, value: np.ndarray) -> None:
        self.held.append((g, ordinal, value))
        self.waiting += len(g)
        if self.waiting > 1_000_000:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, ordinal, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.held) if self.held else [()] * 3))
        order = np.lexsort((ordinal, -value, g))
        g = g[order]
        kept = order[np.arange(len(g)) - np.searchsorted(g, g) < self.top]
        out = tuple(x[kept] for x in (np.concatenate([np.zeros(0, np.int64), *y]) for y in (zip(*self.held) if self.held else [()] * 3)))
        self.held, self.waiting = [out], 0
        return out


def _scored(terms: DataFrame, groups: list, top: int) -> DataFrame:
    """Both parts from one pass: pair (g, o = another group, summed f) and term (g, o = ordinal, f, the first of the task).

    ``groups`` (lang, n: counts of all kept terms, v: kept terms of the language) lie in the order
    of g, those of a language together.
    """
    lang = np.unique([r["lang"] for r in groups], return_inverse=True)[1] if groups else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(lang, prepend=-1, append=-1))
    n, v = (np.array([r[c] for r in groups], np.int64) for c in ("n", "v"))
    under = np.maximum(n + v, 1)
    missing = shares(np.zeros(len(n), np.int64), under)
    whole = np.array([n[a:b].sum() + v[a] for a, b in zip(edge[:-1], edge[1:])], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        first = _First(top)
        for batch in batches:
            ordinal, held = batch.column(0).to_numpy(), batch.column(1)
            flat = held.flatten()
            g, count = flat.field("g").to_numpy().astype(np.int64), flat.field("n").to_numpy()
            at = held.offsets.to_numpy() - held.offsets[0].as_py()
            of = np.searchsorted(edge, g[at[:-1]], "right") - 1  # the language of each term
            row = np.repeat(np.arange(len(held)), np.diff(at))
            p = shares(count, under[g])
            q = shares(np.add.reduceat(count, at[:-1]) if len(held) else count, whole[of])[row]
            more = p > q
            first.add(g[more], ordinal[row[more]], ((p - q) * (p - q) // q)[more])
            for k in np.unique(of).tolist():
                low, high = edge[k], edge[k + 1]
                own = np.flatnonzero(of == k)
                total = sums.setdefault(k, np.zeros((high - low, high - low), np.int64))
                for part in np.array_split(own, -(-len(own) * (high - low) // 1_000_000)):
                    dense = np.tile(missing[low:high], (len(part), 1))
                    here = np.flatnonzero(np.isin(row, part))
                    dense[np.searchsorted(part, row[here]), g[here] - low] = p[here]
                    for j in range(high - low):
                        apart = dense[:, j:j + 1] - dense
                        total[j] += (apart * apart // dense).sum(axis=0)
        names = ["term", "g", "o", "value"]
        for k, total in sums.items():
            size = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(size * size, bool)), pa.array(edge[k] + np.repeat(np.arange(size), size)),
                                              pa.array(edge[k] + np.tile(np.arange(size), size)), pa.array(total.ravel())], names)
        g, o, value = first.rows()
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(g), bool)), pa.array(g), pa.array(o), pa.array(value)], names)
    return stored(terms.select("ordinal", "held").mapInArrow(run, "term boolean, g long, o long, value long"), "scored")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    named = _named(docs)
    seen = stored(sorted_parts(named.select("lang", "source").distinct(), "lang", "source"), "sources")
    groups = stored(seen.join(part_offsets(seen, F.count(F.lit(1))), "_part").select(
        "lang", "source", (F.col("_before") + F.col("_at")).alias("g")), "groups")
    listed = groups.orderBy("g").collect()  # the result has their square in rows
    vocab = vocabulary(kept_terms(named, least))
    by_term = recounted(named, transducers(vocab), listed)
    kept = {r.lang: r.v for r in vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}
    total = {r.g: r.n for r in by_term.select(F.inline("held")).groupBy("g").agg(F.sum("n").alias("n")).collect()}
    scored = _scored(by_term, [{"lang": r.lang, "n": total.get(r.g, 0), "v": kept.get(r.lang, 0)} for r in listed], top)
    sums = scored.where("NOT term").groupBy("g", "o").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("g").alias("o"), F.col("source").alias("item"))
    pairs = groups.join(other, "lang").where("g != o").join(sums, ["g", "o"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    order = Window.partitionBy("g").orderBy(F.desc("value"), "o")
    first = scored.where("term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    terms = first.join(vocab.select(F.col("ordinal").alias("o"), F.col("term").alias("item")), "o").join(groups, "g").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
token AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS term FROM doc),
kept AS MATERIALIZED (SELECT lang, term FROM token GROUP BY ALL HAVING count(DISTINCT k) >= 3),
here AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM token JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS n FROM here GROUP BY ALL),
share AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (coalesce(t.n, 0)::HUGEINT + s.v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN total t USING (lang, source)
       LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q
  FROM here JOIN size USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
       LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM share JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term QUALIFY rank <= 200
"""
