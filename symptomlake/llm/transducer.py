"""A minimal acyclic transducer from the terms of a sorted list to their places in it.

It is built in one pass over the sorted terms: what the next term does not share with the last one is closed, and a
closed state that equals an earlier one (same end mark, same bytes, same targets) is replaced by it. Each state knows how
many terms it leads to, so a transition's output is the number of terms that come before those behind it; the sum of
the outputs along a term is its place. States are packed as bit sets over the bytes in use, with the transitions in one
array, so many terms are read in step, one byte of each at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import astuple, dataclass

import numpy as np


@dataclass(frozen=True)
class Transducer:
    symbol: np.ndarray  # of each byte; 255 for bytes that no term has
    words: int  # bit set words of a state
    has: np.ndarray  # bit sets: which symbols lead on
    first: np.ndarray  # transitions before those of each word
    target: np.ndarray
    output: np.ndarray
    ends: np.ndarray  # a term ends in the state
    root: int

    def packed(self) -> bytes:
        return pickle.dumps(astuple(self), protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> Transducer:
        return cls(*pickle.loads(raw))

    @property
    def states(self) -> int:
        return len(self.ends)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each stretch of ``data`` in the sorted list, or -1 where it is not in it."""
        size = ends - starts
        state, place = np.full(len(size), self.root, np.int64), np.zeros(len(size), np.int64)
        out, live, step = np.full(len(size), -1, np.int64), np.arange(len(size)), 0
        while len(live):
            over = size[live] == step
            done = live[over]
            done = done[self.ends[state[done]]]
            out[done] = place[done]
            live = live[~over]
            symbol = self.symbol[data[starts[live] + step]]
            word = state[live] * self.words + np.minimum(symbol >> 6, self.words - 1)
            bit = np.uint64(1) << (symbol & 63).astype(np.uint64)
            held = self.has[word]
            on = (symbol < 255) & (held & bit != 0)
            live, k = live[on], (self.first[word] + np.bitwise_count(held & (bit - np.uint64(1))))[on]
            place[live] += self.output[k]
            state[live] = self.target[k]
            step += 1
        return out


def build(terms: Iterable[bytes]) -> Transducer:
    """From terms in ascending order of their bytes, each once."""
    seen: dict[tuple[bool, bytes, tuple[int, ...]], int] = {}
    behind: list[int] = []  # terms that a state leads to
    way: list[list] = [[False, bytearray(), []]]  # the states along the last term, open still

    def close(depth: int) -> None:
        while len(way) > depth:
            end, labels, targets = way.pop()
            key = (end, bytes(labels), tuple(targets))
            state = seen.get(key)
            if state is None:
                state = seen[key] = len(behind)
                behind.append(end + sum(behind[t] for t in targets))
            if way:
                way[-1][2].append(state)
            else:
                way.append([False, bytearray(), [state]])  # the root, which nothing leads to
                break

    last = b""
    for term in terms:
        same = 0
        for a, b in zip(last, term):
            if a != b:
                break
            same += 1
        close(same + 1)
        for byte in term[same:]:
            way[-1][1].append(byte)
            way.append([False, bytearray(), []])
        way[-1][0] = True
        last = term
    close(0)
    return _laid(seen, behind, way[0][2][0])


def _laid(seen: dict[tuple[bool, bytes, tuple[int, ...]], int], behind: list[int], root: int) -> Transducer:
    n = len(seen)
    count = np.fromiter((len(k[1]) for k in seen), np.int64, n)
    byte = np.frombuffer(b"".join(k[1] for k in seen), np.uint8)
    target = np.fromiter((t for k in seen for t in k[2]), np.int64, len(byte))
    ends = np.fromiter((k[0] for k in seen), bool, n)
    used = np.unique(byte)
    symbol = np.full(256, 255, np.int64)
    symbol[used] = np.arange(len(used))
    words = max(1, -(-len(used) // 64))
    state = np.repeat(np.arange(n), count)
    word = state * words + (symbol[byte] >> 6)
    has = np.zeros(n * words, np.uint64)
    np.bitwise_or.at(has, word, np.uint64(1) << (symbol[byte] & 63).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(np.bitwise_count(has).astype(np.int64))[:-1]]) if n else np.zeros(0, np.int64)
    # Before a transition come the term that ends in its state and all terms behind the state's earlier transitions.
    size = np.asarray(behind, np.int64)[target] if len(target) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    start = np.concatenate([[0], np.cumsum(count)])[:-1]
    output = total[:-1] - total[start[state]] + ends[state]
    small = np.uint32 if max(n, len(target), int(total[-1])) < 2**32 else np.int64
    return Transducer(symbol, words, has, first.astype(small), target.astype(small), output.astype(small), ends, root)
