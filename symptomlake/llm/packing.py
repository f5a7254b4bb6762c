"""Sequence packing along a space-filling curve.

Every text becomes token ids and a closing id 0. The counts of hashed ids are a document's vector; it is projected to
``DIMS`` numbers by fixed random signs, and these are the coordinates of a point on a Hilbert curve. Documents are
sorted by range of the Hilbert key, so neighbours on the curve are alike, and are laid end to end in this order; the
stream is cut every ``size`` tokens. Only the last sequence is not full.

Ids travel once, as two bytes each, to the place that the sorted keys and the running token counts give them. Only the
small keys are sorted. Places need one number for each range, never a global window.

The ids are those of the tokenizers file ``byte_bpe_50k.json``; they are made by the library that reads the same
vocabulary as ranks, five times faster, which the tests compare id by id. As in the tokenizers file, an added token that
stands in a text (``<|endoftext|>``) has its own id.

Nulls and edges: a null text is empty and has the one closing id; null ids sort first on equal keys; documents with
equal ids are told apart by their place in the input, and each is packed; an empty table gives an empty result; one
very long text is tokenised whole and cut over many sequences; other columns are not read.
"""

from __future__ import annotations

import array
import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays
from .order import part_offsets, sorted_parts, stored

SIZE = 1024
DIMS, BITS = 4, 15
PLACES = 4096
END = 0


def vocabulary() -> str:
    """The installed vocabulary file; on each machine, so found again by each worker."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    """The vocabulary's words, but stretches of white space are taken whole; ``encode`` cuts them first."""
    import tiktoken
    with open(path or vocabulary(), "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("bpe", mergeable_ranks=ranks, special_tokens={},
                             pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")


#: The white space that the vocabulary's patterns know.
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


def encode(text: str, path: str | None = None) -> array.array:
    """The ids of a text, added tokens spelled out, and the closing id.

    Of several white-space characters in a row the last one belongs to what
    follows, if anything does. Cutting there, instead of looking ahead in the
    pattern, is faster and takes stretches of any length.
    """
    words, ids, done = _encoder(path), array.array("H"), 0
    for gap in _GAP.finditer(text):
        last = gap.end() - (gap.end() < len(text))
        for piece in (text[done:gap.start()], text[gap.start():last]):
            if piece:
                ids.extend(words.encode_ordinary(piece))
        done = last
    ids.extend(words.encode_ordinary(text[done:]))
    ids.append(END)
    return ids


@lru_cache(maxsize=1)
def added() -> dict[str, int]:
    """The added tokens of the tokenizers file and their ids; none of them takes up white space or asks for whole words."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=1)
def _added_pattern() -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(added(), key=len, reverse=True))) or r"(?!)")


def document_ids(text: str, path: str | None = None) -> array.array:
    """The ids of a text, added tokens by their own id and what lies between as ``encode`` has it, and the closing id."""
    ids, done = array.array("H"), 0
    for token in _added_pattern().finditer(text):
        ids.extend(encode(text[done:token.start()], path)[:-1])
        ids.append(added()[token.group()])
        done = token.end()
    ids.extend(encode(text[done:], path))
    return ids


# -- the curve --------------------------------------------------------------

_SIGNS = np.where(np.random.default_rng(20_240_305).random((PLACES, DIMS)) < 0.5, -1.0, 1.0)


def points(ids: list[np.ndarray]) -> np.ndarray:
    """One row of ``DIMS`` coordinates (0 .. 2**BITS - 1) for each id list."""
    out = np.zeros((len(ids), DIMS))
    for k, own in enumerate(ids):
        place = (own.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(32 - 12)
        vector = np.sqrt(np.bincount(place, minlength=PLACES) / max(1, len(own)))  # of length 1
        out[k] = vector @ _SIGNS
    # Length-1 vectors of at most PLACES parts project into [-sqrt(PLACES), sqrt(PLACES)]; most lie far inside.
    return np.clip((np.tanh(out / 8) + 1) / 2 * 2**BITS, 0, 2**BITS - 1).astype(np.int64)


def hilbert(x: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates.

    Coordinates are turned into the curve's frame bit by bit, from the top:
    where a bit is set the lower bits of the first axis are flipped, else they
    are exchanged with the axis; a Gray code of what is left is the place.
    """
    x = x.copy()
    dims = x.shape[1]
    for bit in range(BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            on = (x[:, d] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for bit in range(BITS - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(BITS - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> bit) & 1)
    return key


# -- the jobs ---------------------------------------------------------------

def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """row_id, doc_id, doc_tokens, key (place on the curve) and ids (two bytes each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in arrays.runs(batch):
                ids = [document_ids(x or "", path) for x in part.column(1).to_pylist()]
                keys = hilbert(points([np.frombuffer(x, np.uint16) for x in ids]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(keys, pa.int64()),
                     pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "doc_tokens", "key", "ids"])
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, doc_tokens long, key long, ids binary")
    return stored(made.withColumn("row_id", F.monotonically_increasing_id()), "token-ids")


def places(tokens: DataFrame) -> DataFrame:
    """row_id and ``before``, the number of tokens laid before that document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = done + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - n), batch.column(2), batch.column(1)], ["row_id", "inside", "_part", "n"])
            done = int(ends[-1]) if len(ends) else done
    parts = sorted_parts(tokens.select("key", "doc_id", "row_id", "doc_tokens"), "key", "doc_id", "row_id")
    laid = stored(parts.select("row_id", "doc_tokens", "_part")
                  .mapInArrow(run, "row_id long, inside long, _part int, n long"), "places")
    offsets = part_offsets(laid, F.sum("n"))
    return laid.join(F.broadcast(offsets), "_part").select("row_id", (F.col("inside") + F.col("_before")).alias("before"))


PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "ids array<int>")


def pack(docs: DataFrame, size: int = SIZE, with_ids: bool = True, path: str | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence, with its ids unless they are not asked for."""
    tokens = tokenised(docs, path)
    # Both sides grow with the documents, so neither is ever sent whole to every executor.
    placed = tokens.select("row_id", "doc_id", "ids").join(places(tokens).hint("merge"), "row_id").select(
        "doc_id", "before", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, raw = batch.column(1).to_numpy(), batch.column(2)
            for first in range(0, batch.num_rows, 256):
                out = [[] for _ in range(7)]
                pieces = []
                for k in range(first, min(first + 256, batch.num_rows)):
                    ids = np.frombuffer(raw[k].as_buffer(), np.uint16).astype("<u4")
                    at, doc_id = int(before[k]), batch.column(0)[k].as_py()
                    cuts = [0, *range(size - at % size, len(ids), size), len(ids)]
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        row = (doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), (at + a) // size, (at + a) % size)
                        for column, value in zip(out, row):
                            column.append(value)
                        pieces.append(ids[a:b].view("<i4") if with_ids else None)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), pa.array(pieces, pa.list_(pa.int32()))],
                                                 [x.split()[0] for x in PIECE.split(", ")])
    out = placed.mapInArrow(run, PIECE)
    return out if with_ids else out.drop("ids")
