"""Toxicity by cumulative-link ordinal regression on sparse text features.

``P(grade <= k) = sigmoid(threshold_k - w x)`` with one weight vector ``w`` for all ordered thresholds; the answer is
the expected severity, the sum over ``k`` of ``P(grade > k)``. Features are the different words of a text and their
beginnings of 5 to 8 bytes (A-Z lower-cased), hashed to ``2**bits`` places, so inflected forms share weight. A place
that occurs counts 1, or less if more than ``COMMON`` of the training rows have it. Weights are learnt by coordinate-wise
follow-the-regularised-leader steps with an absolute penalty, thresholds by gradient steps that keep their order.

A label table with a ``grade`` (0 .. 3) trains as it is. Labels that say only toxic or not are graded by the training
task: a place is marked if toxic rows of the sample hold it ``MARKED`` times as often as others; toxic rows are cut into
three grades at the terciles of their marked words. Training reads at most ``max_train`` labelled rows, those with the
smallest hash of their id. Scoring reads whole texts.

Nulls and edges: a null text is empty and has no features; rows without id or label, and labels outside the range, do
not train; several labels of an id all train, each with one of its rows; with one real grade only, every row gets it, and
without binary labels of both kinds every severity is 0; repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .quality import KIND, fold, labelled

STARTS = (0, 5, 6, 7, 8)  # 0: the whole word
MARKED = 5.0
COMMON = 0.02
GRADES = 4


@dataclass(frozen=True)
class Ordinal:
    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.027  # times the root of the number of rows
    l2: float = 0.05
    epochs: int = 5
    max_train: int = 32_768


def occurrences(at: np.ndarray, data: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of every word, one array for each of ``STARTS``, and the first word of each document."""
    low = arrays.LOWER[data]
    starts, ends, first = arrays.split(at, (KIND[low] == 1).astype(np.uint8))
    out = []
    for k, size in enumerate(STARTS):
        stop = np.minimum(ends, starts + size) if size else ends
        h = arrays.mix(arrays.hashes(low, starts, stop) + np.uint64(k))
        place = (h >> np.uint64(64 - bits)).astype(np.int64)
        out.append(place if not size else np.where(ends - starts >= size, place, -1))
    return out, first


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, int]], m: Ordinal) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the worth of each place included) and ordered thresholds from (places, grade)."""
    z, n = np.zeros(1 << m.bits), np.zeros(1 << m.bits)
    held = np.bincount(np.concatenate([p for p, _ in rows]), minlength=1 << m.bits)
    worth = np.minimum(1.0, COMMON * len(rows) / np.maximum(held, 1))
    penalty = m.l1 * len(rows) ** 0.5

    def weights(zi, ni):
        return np.where(np.abs(zi) <= penalty, 0.0,
                        (np.sign(zi) * penalty - zi) / ((m.beta + np.sqrt(ni)) / m.alpha + m.l2))

    share = np.cumsum(np.bincount([g for _, g in rows], minlength=GRADES))[:-1] / len(rows)
    cut = np.log((share + 1e-3) / (1 - share + 1e-3)) + np.arange(GRADES - 1) * 1e-3
    slope_sum = np.ones(GRADES - 1)
    for _ in range(m.epochs):
        for place, grade in rows:
            x, zi, ni = worth[place], z[place], n[place]
            w = weights(zi, ni)
            upto = np.concatenate([[0.0], _sigmoid(cut - (w * x).sum()), [1.0]])
            curve = upto * (1 - upto)
            chance = max(upto[grade + 1] - upto[grade], 1e-9)
            slope = (curve[grade + 1] - curve[grade]) / chance * x
            grown = ni + slope * slope
            z[place] = zi + slope - (np.sqrt(grown) - np.sqrt(ni)) / m.alpha * w
            n[place] = grown
            step = np.zeros(GRADES - 1)
            if grade < GRADES - 1:
                step[grade] -= curve[grade + 1] / chance
            if grade:
                step[grade - 1] += curve[grade] / chance
            slope_sum += step * step
            cut = np.maximum.accumulate(cut - 0.3 * step / np.sqrt(slope_sum))
    return weights(z, n) * worth, cut


def graded(rows: list[tuple[np.ndarray, int]], bits: int) -> list[int]:
    """Grades 0 .. 3 of rows labelled 0 or 1, by the marked places of the toxic ones."""
    y = np.array([label for _, label in rows], bool)
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int64)] + [p for (p, _), v in zip(rows, y) if v == kind]),
                        minlength=1 << bits) for kind in (False, True)]
    rate = (seen[1] / max(1, y.sum())) / ((seen[0] + 1.0) / max(1, (~y).sum()))
    marked = (rate >= MARKED) & (seen[1] >= 5)
    hits = np.array([marked[p].sum() for p, _ in rows])
    low, high = np.quantile(hits[y], [1 / 3, 2 / 3])
    return [0 if not v else 1 if h <= low else 2 if h <= high else 3 for v, h in zip(y, hits)]


def train(docs: DataFrame, labels: DataFrame, model: Ordinal = Ordinal()) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from ``labels`` (doc_id and grade 0 .. 3, or toxic 0 or 1)."""
    real = "grade" in labels.columns

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                found, first = occurrences(at, data, model.bits)
                own = (np.unique(np.concatenate([f[a:b] for f in found])) for a, b in zip(first[:-1], first[1:]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([p[p >= 0].astype("<i4").tobytes() for p in own], pa.binary())],
                    ["turn", "doc_id", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(p.as_py(), "<i4").astype(np.int64), y.as_py())
                for b in batches for p, y in zip(b.column("places"), b.column("label"))]
        w, cut = np.zeros(0), np.full(GRADES - 1, 35.0)
        seen = {y for _, y in rows}
        if len(seen) > 1:
            grades = [y for _, y in rows] if real else graded(rows, model.bits)
            w, cut = fit([(p, g) for (p, _), g in zip(rows, grades)], model)
        elif real and seen:
            cut = np.where(np.arange(GRADES - 1) < min(seen), -35.0, 35.0)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, -1 - np.arange(len(cut))]), pa.int64()),
                                          pa.array(np.concatenate([w[used], cut]), pa.float64())], ["place", "weight"])
    learnt = (labelled(docs, labels, *(("grade", model.max_train, GRADES - 1) if real else ("toxic", model.max_train)))
              .mapInArrow(featurise, "turn long, doc_id long, label int, places binary").repartition(1)
              .sortWithinPartitions("turn", "doc_id", "label", "places").mapInArrow(learn, "place long, weight double").toArrow())
    place, weight = learnt.column("place").to_numpy(), learnt.column("weight").to_numpy()
    out, cut = np.zeros(1 << model.bits, np.float32), np.full(GRADES - 1, 35.0)
    out[place[place >= 0]] = weight[place >= 0]
    cut[-1 - place[place < 0]] = weight[place < 0]
    return out, cut


def severities(at: np.ndarray, data: np.ndarray, weights: np.ndarray, cut: np.ndarray, bits: int) -> np.ndarray:
    """``P(grade > k)`` for each document (row) and threshold (column)."""
    found, first = occurrences(at, data, bits)
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    used = [(docs[hit], place[hit]) for place in found for hit in [np.flatnonzero((place >= 0) & (weights[place] != 0))]]
    pair = np.unique(np.concatenate([(d << bits) | p for d, p in used]))
    margin = np.bincount(pair >> bits, weights[pair & ((1 << bits) - 1)], len(first) - 1)
    return np.round(_sigmoid(margin[:, None] - cut[None, :]), 9)


def score(docs: DataFrame, labels: DataFrame, model: Ordinal = Ordinal(), least: float = 0.25) -> DataFrame:
    """doc_id, held_out, expected_severity (0 to 3), grade (likeliest), p_toxic and toxic of every row."""
    weights, cut = train(docs, labels.where(~fold()), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                over = severities(at, data, weights, cut, model.bits)
                each = np.hstack([np.ones((len(over), 1)), over]) - np.hstack([over, np.zeros((len(over), 1))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(over.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)),
                     pa.array(over[:, 0])], ["doc_id", "expected_severity", "grade", "p_toxic"])
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, expected_severity double, grade int, p_toxic double")
    return out.select("doc_id", fold().alias("held_out"), "expected_severity", "grade", "p_toxic",
                      (F.col("p_toxic") >= least).cast("int").alias("toxic"))
