import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from symptomlake.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def test_hilbert_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 4)
    for dims in (2, 3):
        cells = np.array(np.meshgrid(*[range(16)] * dims)).reshape(dims, -1).T
        key = packing.hilbert(cells)
        assert sorted(key) == list(range(16**dims))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_ids_are_the_tokenizers(tokenizer):
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c　'sdtm aZé9²_-!<|>"), st.characters(codec="utf-8")), max_size=40))
    def run(text):
        assert packing.encode(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    run()
    for text in ("<|endoftext|> it's  don't've\n\n x", " \n a", "a  ", "", "naïve ½ 12,345.6   b"):
        assert packing.encode(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_added_tokens(spark):
    """As the tokenizers file has it by default."""
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x \n <|endoftext|><|endoftext|>  \n y  ", "<|endoftext |> <|endoftext|", "it's<|endoftext|>'s  ", ""]
    want = [[*default.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    assert [packing.document_ids(t).tolist() for t in texts] == want
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids for r in out} == dict(enumerate(want))


def test_long_stretches():
    for text in (" " * 1_000_000, "\n " * 500_000, "a" * 1_000_000, " x" * 5 + " " * 300_000 + "y"):
        assert packing.encode(text)[-1] == 0


def test_every_id_once(spark, tokenizer):
    rows = [(k, f"word{k % 5} and more " * (k % 37), 1) for k in range(300)] + [(7, "again", 1), (7, "again", 1), (None, None, 1), (400, "", 1), (401, "long text " * 9000, 1)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    stream = {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert any(ids[r.start:r.start + r.length] == r.ids and len(ids) == r.doc_tokens for ids in want[r.doc_id])
        stream.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(ids) for v in want.values() for ids in v)
    assert sum(r.length for r in out) == total and len(stream) == -(-total // 1024)
    for k, pieces in stream.items():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:j]) for j in range(len(pieces))]
        assert sum(n for _, n in pieces) == (1024 if k < len(stream) - 1 else total - 1024 * (len(stream) - 1))


def test_like_documents_are_neighbours(spark):
    rows = [(k, ("alpha beta gamma delta " if k % 2 else "uno dos tres cuatro ") * 50 + str(k)) for k in range(200)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("sequence_id", "offset").collect()
    kinds = [r.doc_id % 2 for r in out if r.start == 0]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) < 20


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
