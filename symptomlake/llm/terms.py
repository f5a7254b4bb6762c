"""In how many documents does a term occur: counts over a whole corpus for a given set of terms.

A term is a stretch of letters and digits, A-Z lower-cased; all signs outside ASCII count as letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .quality import KIND

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
TABLE_BITS = 23


def term_hashes(words: list[str]) -> np.ndarray:
    """Hashes of terms, one by one as in the texts."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    data = arrays.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    return arrays.hashes(data, ends - np.array([len(w) for w in raw], np.int64), ends).view(np.int64)


def _place(h: np.ndarray) -> np.ndarray:
    return (arrays.mix(h.view(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def bit_table(terms: DataFrame) -> np.ndarray:
    """2**TABLE_BITS bits with one set for each hash in ``terms`` (term): 1 MB whatever their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
        for batch in batches:
            place = _place(batch.column(0).to_numpy())
            np.bitwise_or.at(table, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(table[used].astype(np.int16))], ["byte", "bits"])
    found = (terms.select("term").mapInArrow(run, "byte int, bits short")
             .groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow())
    table = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
    table[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return table


def count_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n_term, the number of documents that hold it, for the hashes in ``terms``.

    Each task adds up what it has read and sends one row for each term.
    """
    table = bit_table(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = [term]
            for _, at, data in arrays.runs(batch):
                low = arrays.LOWER[data]
                starts, ends, first = arrays.split(at, (KIND[low] == 1).astype(np.uint8))
                h = arrays.hashes(low, starts, ends)
                place = _place(h)
                hit = np.flatnonzero((table[place >> 3] >> (place & 7)) & 1)
                row = np.searchsorted(first, hit, "right") - 1
                order = np.lexsort((h[hit], row))
                row, own = row[order], h[hit].view(np.int64)[order]
                new = np.ones(len(own), bool)
                new[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1])  # a document counts once
                held.append(own[new])
            found, back = np.unique(np.concatenate(held), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, np.ones(len(back) - len(term))]), len(found)).astype(np.int64)
            term = found
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], ["term", "n"])
    held = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return held.join(terms, "term", "left_semi")
