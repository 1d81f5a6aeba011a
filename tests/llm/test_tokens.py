"""Token operators against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import bpe, queries, token_files
from marketlens.llm.common import read_table
from marketlens.llm.pieces import byte_level_encoder, split_special
from tests.llm.helpers import SCHEMA, documents, frame

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "\n\n a", "it's we'll 's ''s \"'s don'T", "'s'", "x 's", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "  <|endoftext|>  x",
    "ΑΣ ΑΣΑ İǅ", "a" * 700, "éa" * 300, "e\u0301 o\u0308", "日本語🙂 12345", "\x1c\x85\u00a0\u2003x", "A  B\tC \n D ",
]
LETTERS = "aabcdestrlmv''' \n\t 0123  éÉßİΣσς.,!?\"-_<|>日🙂\u0301\u00a0"


@pytest.fixture(scope="module")
def encoders():
    return {BYTE: byte_level_encoder(BYTE), WORD: bpe.codec(WORD).encode}


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(encoders, path):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(2000)]
    library = Tokenizer.from_file(path)
    assert split(*encoders[path](texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text_is_encoded_as_by_the_library(encoders, texts):
    for path, encode in encoders.items():
        library = Tokenizer.from_file(path) if not hasattr(encode, "library") else encode.library
        encode.library = library
        assert split(*encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pair_test_agrees_with_merging():
    merger, rng = bpe.codec(WORD).merger, random.Random(5)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    assert merger.encode_words(words) == [merger.merge(merger.start(w.encode())) for w in words]
    proposed, ok = merger.greedy([w.encode() for w in words])
    assert ok.all() and any(p != merger.merge(merger.start(w.encode())) for p, w in zip(proposed, words, strict=True))


def test_special_strings_split_a_text():
    assert split_special("a<x><xy>b", {"<x>": 1, "<xy>": 2, "<x": 3}) == ["a", 1, 2, "b"]


def test_encode_decode_keeps_other_columns(spark):
    rows = [*documents(n=12), (None, "it's", "en", "s", 1, 0.5, "x", 1, 2, "y"), (3, None, "en", "s", 1, 0.5, "x", 1, 2, "y")]
    got = bpe.encode_decode(frame(spark, rows), WORD).collect()
    library = Tokenizer.from_file(WORD)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    want = [(r[0], ids(r[1]), library.decode(ids(r[1]), skip_special_tokens=False), r[6]) for r in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.ids, r.decoded, r.digest)) for r in got)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(spark, rows), WORD).collect()}
    assert digests == {(d, len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t, _ in want}


def test_token_files_hold_ids_in_order(spark):
    rows = [*documents(n=12), (3, "b", *rows_tail()), (3, "a", *rows_tail()), (None, None, *rows_tail())]
    files = token_files.write(frame(spark, rows), BYTE, 2)
    got = sorted(files.read(spark).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(BYTE)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), ids))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    sums = {(r.start, r.ids_crc32) for r in token_files.checksums(files.read(spark)).collect()}
    assert sums == {(s, zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for _, s, _, i in want}
    assert "ids" not in files.metadata(spark).columns
    assert files.read(spark, "doc_id = 15").count() == 1


def rows_tail():
    return documents(n=1)[0][2:]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_files.write(none, BYTE, 2).read(spark).count() == 0
    assert bpe.encode_decode(none, WORD).count() == 0


def test_rows_without_id_go_to_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_SHARD_BYTES", 200)
    monkeypatch.setattr(token_files, "SHARD_ROOT", 1)
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    assert token_files.write(docs, BYTE, 2).metadata(spark).select("shard").distinct().count() > 2


def test_pieces_beyond_the_limit_are_forgotten_without_a_trace():
    rng = random.Random(8)
    encode = byte_level_encoder(BYTE)
    encode.words._limit = 300
    library = Tokenizer.from_file(BYTE)
    for _ in range(40):
        texts = ["".join(rng.choice(LETTERS) for _ in range(60)) for _ in range(20)]
        assert split(*encode(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_file_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(read_table(spark, sf, "documents").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_files(spark, sf).collect()}
    library, start = Tokenizer.from_file(BYTE), 0
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got.pop(r.doc_id) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not got


def test_results_names_in_docs_are_refused(spark):
    with pytest.raises(ValueError, match="results"):
        bpe.encode_decode(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, ids string"), WORD)
