"""Document quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader (proximal).

Tokens are stretches of letters and digits, and stretches of other signs. A document is a sparse vector over
``2**bits`` places: one- to two-token n-grams of the tokens, and one- to three-token n-grams of the tokens' forms
(case, signs, length class, repeats of the token before). A value is ``SCALE`` times the n-gram's share of its family,
so a score is a sparse dot product that does not grow with the text. The weights are one array of fixed size.

Training reads at most ``max_train`` labelled rows, those with the smallest hash of their id, in that order. Scoring
reads every whole text.

Nulls and edges: a null text is empty, and an empty text has only the bias; rows without id or label, and labels that are
neither 0 nor 1, do not train; an id with several labels trains once per label, with one of its rows; without training rows of both kinds every score is the mean label,
or 0.5; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays

#: Byte classes: 0 white space, 1 letters, digits and all bytes of other scripts, 2 other signs.
KIND = np.full(256, 2, np.uint8)
KIND[arrays.SPACE] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
UPPER = np.isin(np.arange(256), np.arange(65, 91))
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
HELD_OUT = 2
SCALE = 10.0
#: (family, longest n-gram): surface tokens and their forms.
FAMILIES = ((1, 2), (2, 3))


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 4
    max_train: int = 8192


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Form code of each token; signs keep their own identity up to three of them."""
    upper, digit = (np.concatenate([[0], np.cumsum(t[data])]) for t in (UPPER, DIGIT))
    size = ends - starts
    big, num = upper[ends] - upper[starts], digit[ends] - digit[starts]
    case = np.where(num * 2 > size, 4, np.where(big == 0, 0, np.where(big == size, np.where(size > 1, 3, 1), 1)))
    length = np.minimum(np.frexp(size)[1], 7)
    same = np.zeros(len(token), np.int64)
    same[1:] = token[1:] == token[:-1]
    same[first[:-1][first[:-1] < len(token)]] = 0
    code = (case * 8 + length) * 2 + same
    sign = KIND[data[starts]] == 2
    return np.where(sign, arrays.mix(token ^ np.uint64(77)), arrays.mix(code.astype(np.uint64) + np.uint64(1)))


def grams(at: np.ndarray, data: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Family, places (-1: an n-gram that would leave its document) and first token of each document, per n-gram size."""
    starts, ends, first = arrays.split(at, KIND[data])
    token = arrays.hashes(arrays.LOWER[data], starts, ends)
    form = _forms(data, starts, ends, token, first) if len(token) else token
    last = np.repeat(first[1:], np.diff(first))  # end of the document of each token
    for (family, longest), seq in zip(FAMILIES, (token, form)):
        h = np.full(len(seq), np.uint64(family))
        for n in range(longest):
            h = arrays.mix(h[:len(seq) - n] ^ seq[n:]) if n < len(seq) else h[:0]
            place = (h >> np.uint64(64 - bits)).astype(np.int64)
            place[np.arange(len(h)) + n >= last[:len(h)]] = -1
            yield family, place, np.minimum(first, len(h))


def vectors(at: np.ndarray, data: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (ascending, different) and values of each document; place 0 holds the bias."""
    found = list(grams(at, data, bits))
    for d in range(len(at) - 1):
        places, values = [np.zeros(1, np.int64)], [np.ones(1)]
        for family, _ in FAMILIES:
            own = np.concatenate([p[f[d]:f[d + 1]] for k, p, f in found if k == family])
            place, count = np.unique(own[own >= 0], return_counts=True)
            places.append(place)
            values.append(SCALE * count / max(1, count.sum()))
        place, back = np.unique(np.concatenate(places), return_inverse=True)
        yield place, np.bincount(back, np.concatenate(values), len(place))


def probabilities(at: np.ndarray, data: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Scores of all documents of a slice: the dot products of ``vectors``, summed n-gram by n-gram."""
    margin = np.full(len(at) - 1, float(weights[0]))
    total, count = {k: np.zeros(len(at) - 1) for k, _ in FAMILIES}, {k: np.zeros(len(at) - 1) for k, _ in FAMILIES}
    for family, place, first in grams(at, data, bits):
        inside = place >= 0
        for out, each in ((total, np.where(inside, weights[place], 0.0)), (count, inside)):
            run = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            out[family] += run[first[1:]] - run[first[:-1]]
    for k in total:
        margin += SCALE * total[k] / np.maximum(count[k], 1)
    return np.round(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))), 9)  # equal texts in other slices: equal scores


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], m: Ftrl) -> np.ndarray:
    """Weights after ``epochs`` passes over the rows in their order."""
    z, n = np.zeros(1 << m.bits), np.zeros(1 << m.bits)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= m.l1, 0.0, (np.sign(zi) * m.l1 - zi) / ((m.beta + np.sqrt(ni)) / m.alpha + m.l2))

    for _ in range(m.epochs):
        for place, value, label in rows:
            zi, ni = z[place], n[place]
            value = value.astype(np.float64)
            w = weights(zi, ni)
            slope = (1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            grown = ni + slope * slope
            z[place] = zi + slope - (np.sqrt(grown) - np.sqrt(ni)) / m.alpha * w
            n[place] = grown
    return weights(z, n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, highest: int = 1) -> DataFrame:
    """turn, doc_id, label and text of at most ``most`` pairs of an id and a label (0 .. ``highest``): the least hashes of ids.

    They are bounded, so they may be broadcast; documents are read once. Of the
    documents of an id one stays for each of its labels, that with the least
    text hash; it is chosen on the map side first, so an id with very many rows
    sends one text per task.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).between(0, highest))
              .select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).distinct()
              .withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id", "label").limit(most))
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("turn", "doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", model: Ftrl = Ftrl()) -> np.ndarray:
    """Weights from ``labels`` (doc_id, ``label`` 0 or 1) and the texts of ``docs``.

    The features of the chosen rows meet in one task, which runs the sequential updates.
    """
    pairs = labelled(docs, labels, label, model.max_train)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                found = list(vectors(at, data, model.bits))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()),
                     pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                    ["turn", "doc_id", "label", "places", "vals"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Views of the batches; numbers become doubles row by row in ``fit``.
        rows = [(np.frombuffer(p.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4"), y.as_py())
                for b in batches for p, v, y in zip(b.column("places"), b.column("vals"), b.column("label"))]
        seen = [y for *_, y in rows]
        w = fit(rows, model) if len(set(seen)) == 2 else np.zeros(1 << model.bits)
        if rows and len(set(seen)) == 1:
            w[0] = 35.0 if seen[0] else -35.0
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used], pa.float64())], ["place", "weight"])

    sparse = pairs.mapInArrow(featurise, "turn long, doc_id long, label int, places binary, vals binary")
    learnt = (sparse.repartition(1).sortWithinPartitions("turn", "doc_id", "label", "places")
              .mapInArrow(learn, "place long, weight double").toArrow())
    out = np.zeros(1 << model.bits, np.float32)
    out[learnt.column("place").to_numpy()] = learnt.column("weight").to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int = Ftrl.bits) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier) of every row. The weights are ``2**bits`` floats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(probabilities(at, data, weights, bits))], ["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def fold() -> Column:
    """Whether a row belongs to the held-out quarter; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows do not train."""
    weights = train(docs, labels.where(~fold()), "quality", model)
    return score(docs, weights, model.bits).select(
        "doc_id", fold().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    The score is computed beside the text in one pass over the rows, so nothing is shuffled.
    """
    weights = train(docs, labels.where(~fold()), "quality", model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows stay in Arrow: texts are not copied into objects, and kept ones slice by slice only
            for part, at, data in arrays.runs(batch):
                yield part.filter(pa.array(probabilities(at, data, weights, model.bits) >= threshold))
    return docs.mapInArrow(run, docs.schema)
