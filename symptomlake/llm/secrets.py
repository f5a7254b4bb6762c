"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a value assigned to a name such as ``token`` or ``password`` (quoted or not, of any length and signs, in
one line), what follows ``Bearer``, a value with the prefix of a known kind of key, and elsewhere a stretch of at least
``LEAST`` letters, digits and ``+/_=-`` with a digit in it. The forest sees its length, shares of character classes, character transitions (mean log-probability of its byte pairs in the whole
corpus, and how often the class changes), dictionary coverage (the share of its letters in runs that are terms of
their own in ``KNOWN`` texts or more), signs of a path or address, and the neighbouring words, hashed to a few places.

It is trained from labelled findings: any table of findings with a ``label``. ``rule_labels`` makes one where there is
none: values of named keys, after ``Bearer`` and with a known prefix are secrets; numbers, parts of addresses and paths,
UUIDs, and what follows a word such as ``commit`` or ``sha256`` are not. Any other candidate has no label, nor has a bare
word of letters after ``password:``, which may be prose; the forest judges them. At most ``MOST`` findings of each label
train, those with the smallest hash. All counts cover the whole corpus.

Nulls and edges: a null text has no findings; null ids are kept; equal rows give equal findings; without findings of
both labels every answer is the one label there is, or 0; an empty table gives an empty result; texts of any length are
read whole; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .order import stored
from .quality import fold
from .terms import count_documents, term_hashes

LEAST, KNOWN, MOST = 16, 5, 4096
PLACES = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_RUN = re.compile(r"[A-Za-z]{4,}")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_LAST_WORD = re.compile(r"([^\W\d]+)\W*\Z")
_NEXT_WORD = re.compile(r"\W*([^\W\d]+)")
_NAMED = re.compile(r"(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]*(?::=|=>|[:=])[ \t]*", re.I)
_QUOTED = re.compile(r"([\"'])((?:\\.|(?!\1)[^\\\n])+)\1")
_BARE = re.compile(r"[\"']?([^\s\"']\S*)")
_BEARER = re.compile(r"\bbearer[ \t]+([\w.~+/=-]{8,})", re.I)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}"
                       r"|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|AIza[\w-]{35}"
                       r"|(?<![\w-])eyJ[\w-]++\.[\w-]++\.[\w-]+)(?![A-Za-z0-9])", re.ASCII)
_DIGEST = re.compile(r"(?:commit|revision|sha-?\d*|md5|digest|checksum|etag|uuid|guid)[\"']?\s*[:= ]\s*[\"']?\Z", re.I)
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)
_NUMBER = re.compile(r"[0-9+/_=-]+\Z")


def _given(text: str) -> Iterator[tuple[int, int, bool | None]]:
    """Values of named keys, after ``Bearer`` and of known prefix: start, end, and whether the rule calls them secrets."""
    done = 0
    for m in _NAMED.finditer(text):
        if m.end() < done:  # inside another value; so each character is read once
            continue
        value = _QUOTED.match(text, m.end())
        if value:
            done = value.end()
            yield (*value.span(2), True)
            continue
        value = _BARE.match(text, m.end())
        if value:
            a, done = value.span(1)
            b = a + len(text[a:done].rstrip(",;.)]}\"'"))
            if a < b:
                yield a, b, True if "=" in m.group() or not text[a:b].isalpha() else None
    for m in _BEARER.finditer(text):
        yield (*m.span(1), None if m.group(1).isalpha() else True)
    for m in _PREFIXED.finditer(text):
        yield (*m.span(), True)


def candidates(text: str) -> Iterator[tuple[int, int, bool | None]]:
    """Start, end and verdict of the rule (None: none) of each candidate, by start; none overlaps another."""
    done = 0
    for a, b, verdict in [*sorted(_given(text), key=lambda c: (c[0], -c[1])), (len(text), len(text), None)]:
        if a < done:
            continue
        for m in _CANDIDATE.finditer(text, done, a):
            value, before = m.group(), text[max(0, m.start() - 64):m.start()]
            if any(map(str.isdigit, value)):
                harmless = _NUMBER.match(value) or _UUID.match(value) or _in_path(before) or _DIGEST.search(before)
                yield (*m.span(), False if harmless else None)
        if a < b:
            yield a, b, verdict
        done = b


def _in_path(before: str) -> bool:
    return before[-1:] in ("/", ".", "@", "\\") or "://" in before.rsplit(" ", 1)[-1]


def transitions(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of the next byte after a byte, over all texts (A-Z lower-cased): a 256 x 256 table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, at, data in arrays.runs(batch):
                low = arrays.LOWER[data].astype(np.int64)
                pair = low[:-1] * 256 + low[1:]
                inside = np.ones(len(pair), bool)
                inside[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(low))] - 1] = False  # not across documents
                total += np.bincount(pair[inside], minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["pair", "n"])
    found = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 16)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(256, 256) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


FINDING = ("doc_id long, start int, end int, given boolean, runs array<long>, sizes array<int>, features array<double>")


def _place(word: str) -> float:
    return float(zlib.crc32(word.lower().encode()) % PLACES) if word else -1.0


def _features(text: str, a: int, b: int, logs: np.ndarray) -> list[float]:
    value = text[a:b]
    raw = np.frombuffer(value.encode(), np.uint8)
    kind = np.select([(raw >= 48) & (raw <= 57), (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)], [0, 1, 2], 3)
    share = np.bincount(kind, minlength=4) / len(raw)
    each = np.unique(raw, return_counts=True)[1] / len(raw)
    low = arrays.LOWER[raw]
    before, after = text[max(0, a - 64):a], text[b:b + 64]
    word, later = _LAST_WORD.search(before), _NEXT_WORD.match(after)
    return [float(len(value)), *share, len(each) / len(raw), float(-(each * np.log2(each)).sum()),
            float(bool(_HEX.match(value))), float(logs[low[:-1], low[1:]].sum()) / max(1, len(low) - 1),
            float((kind[1:] != kind[:-1]).sum()) / max(1, len(kind) - 1), float(value.count("/")), float(_in_path(before)),
            float(before[-1:] in ("'", '"') and after[:1] == before[-1:]), float(before.rstrip(" '\"")[-1:] in ("=", ":")),
            _place(word.group(1) if word else ""), _place(later.group(1) if later else "")]


def findings(docs: DataFrame, logs: np.ndarray) -> DataFrame:
    """Every candidate with its place, features (coverage still missing), letter runs and the verdict of the naming rule."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in arrays.runs(batch):
                rows, words = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for a, b, given in candidates(text or ""):
                        own = _RUN.findall(text[a:b])
                        rows.append([doc_id, a, b, given, own, list(map(len, own)), _features(text, a, b, logs)])
                        words += own
                ids = iter(term_hashes(words).tolist())
                for row in rows:
                    row[4] = [next(ids) for _ in row[4]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                         pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)],
                                                 [x.split()[0] for x in FINDING.split(", ")])
    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINDING)
                   .withColumn("row", F.monotonically_increasing_id()), "findings")
    pieces = found.select("row", F.explode(F.arrays_zip("runs", "sizes")).alias("r")).select(
        "row", F.col("r.runs").alias("term"), F.col("r.sizes").alias("size"))
    known = count_documents(docs, pieces.select("term").distinct()).where(F.col("n_term") >= KNOWN)
    covered = pieces.join(known, "term").groupBy("row").agg(F.sum("size").alias("covered"))
    share = F.coalesce(F.col("covered"), F.lit(0)) / (F.col("end") - F.col("start"))
    return stored(found.join(covered, "row", "left").select(
        "row", "doc_id", "start", "end", "given", F.concat("features", F.array(share)).alias("features")), "covered")


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings of the training folds that the rule has a verdict on."""
    return found.where(~fold() & F.col("given").isNotNull()).withColumn("label", F.col("given").cast("int"))


def train(labelled: DataFrame):
    """A forest from findings with ``features`` and ``label``, or the only label there is as a number."""
    order = [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start")]
    kept = [labelled.where(F.col("label") == k).orderBy(*order).limit(MOST) for k in (0, 1)]
    rows = stored(kept[0].unionByName(kept[1]).select(
        F.col("label").cast("double").alias("label"), "features", F.xxhash64("doc_id", "start").alias("turn")), "labelled")
    labels = [r.label for r in rows.select("label").distinct().collect()]  # two at most
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    forest = RandomForestClassifier(numTrees=24, maxDepth=8, maxBins=64, seed=20_240_309, featuresCol="vector")
    return forest.fit(rows.orderBy("turn").select("label", array_to_vector("features").alias("vector")))


def scan(docs: DataFrame, labelled=rule_labels, least: float = 0.5) -> DataFrame:
    """doc_id, start_at, end_at (code points, end exclusive), p_secret and secret of every candidate."""
    found = findings(docs, transitions(docs))
    model = train(labelled(found))
    if isinstance(model, float):
        scored = found.withColumn("p", F.lit(model))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn(
            "p", vector_to_array("probability")[1])
    return scored.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"),
                         F.round("p", 9).alias("p_secret"), (F.col("p") >= least).cast("int").alias("secret"))
