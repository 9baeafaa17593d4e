"""Encoding through distinct words against the library on whole texts, and the way back."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from floodlens.llm import word_bpe
from floodlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    ranks = word_bpe.read_ranks(public_tokenizers.path(word_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_word_bpe"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


DOCS = "doc_id long, text string, ids string, decoded int, chunk long, word string, code int"


@pytest.mark.parametrize("size", [1, 40, 2_000_000])
def test_texts_of_all_kinds(spark, library, size):
    rng = random.Random(size)
    texts = [None, "", " ", "a", "  two  spaces\n\n\tand 's it'll 12x", "中文とかな 😀", "՘֋ aᇞ0 ꟎!", "same words same words", "same words same words",
             "<|endoftext|>", "x" * 30_000, "word " * 3_000, "\x85\xa0 　 \x1c\x1f", "é̀"]
    texts += ["".join(rng.choice("ab 's\n\t12!?é½中̀") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(None if i == 3 else 7 if i in (4, 5) else i, t, "x", 1, 2, "y", 3) for i, t in enumerate(texts)]
    encoded = word_bpe.encode(spark.createDataFrame(rows, DOCS).repartition(3), size=size)
    found = word_bpe.decode(encoded, word_bpe.token_bytes(spark)).collect()
    want = sorted(((r[0] if r[0] is not None else -1, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids, bytes(r.decoded)) for r in found) == want
    assert encoded.columns == ["doc_id", "ids"]


def test_empty_table_and_ids(spark):
    assert word_bpe.encode(spark.createDataFrame([], DOCS)).count() == 0
    tokens = word_bpe.token_bytes(spark)
    rows = word_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>"), tokens).collect()
    assert [len(r.decoded) for r in rows] == [0, 0, 1]
    with pytest.raises(Exception, match="not in the vocabulary"):
        word_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), tokens).collect()


def test_a_word_travels_once_per_chunk(spark):
    docs = spark.createDataFrame([(i, "the same few words again and again") for i in range(500)], "doc_id long, text string").repartition(5).select("doc_id", "text")
    lists = word_bpe.word_lists(docs, 3, size=1_000).collect()
    assert len({r.chunk for r in lists}) > 5 and len({(r.chunk, r.bucket) for r in lists}) == len(lists)
    for chunk in {r.chunk for r in lists}:
        joined = [(r.lengths, r.words) for r in lists if r.chunk == chunk]
        assert sum(len(n) for n, _ in joined) == 6 and sorted(b"".join(w for _, w in joined)) == sorted(b"the same few words again and")
    assert word_bpe.document_places(docs, 3, size=1_000).where("place >= 0").count() == 500


def test_rows_in_another_order_are_an_error():
    def chunk(texts):
        own = word_bpe.Chunk()
        for i, t in enumerate(texts):
            own.add(t, pa.array([i]))
        return own

    def both(first, second):
        places, total, codes = chunk(first).place_rows(2)
        documents = pa.table({"place": [-1, *range(len(codes))], "doc_id": [None, *range(len(codes))], "codes": [places, *codes], "total": [total] + [None] * len(codes)})
        lists = chunk(second).word_rows(2)[1]
        ids = [(b, word_bpe.pack_codes(np.ones(len(n), np.int64)), np.arange(len(n), dtype=np.uint16).tobytes(), word_bpe._sum(n, w)) for b, n, w in lists]
        return word_bpe.put_together(documents, pa.table(dict(zip(["bucket", "counts", "ids", "total"], map(list, zip(*ids))))), np.uint16)

    assert both(["a b c", "b a"], ["a b c", "b a"]).num_rows == 2
    with pytest.raises(RuntimeError):
        both(["a b c", "b a"], ["a b d", "b a"])


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for most in (1, 128, 129, 1 << 14, 1 << 31, 1 << 60):
        codes = rng.integers(0, most, 500)
        packed = word_bpe.pack_codes(codes)
        assert (word_bpe.unpack_codes(np.frombuffer(packed, np.uint8)) == codes).all()
        assert most > 128 or len(packed) == 500
    assert word_bpe.pack_codes(np.empty(0, np.int64)) == b""
