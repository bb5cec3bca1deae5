import inspect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from prosemill.llm import op1_token_store as store
from prosemill.llm.common import shared_dir
from prosemill.llm.op5_packing import digests, pack, sequences, sum_of_squares
from prosemill.llm.tokens import encoder, tokenizer_path
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library(library):
    rng, enc = random.Random(3), encoder(tokenizer_path())
    signs = ["a", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>", "B", "é", "É", "ß", "İ", "Σ", "ς", "ǰ", "J̌", "́", "1", "22", "'", "'s", "n't", ".", "...", ",", "|", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "—", "漢", "😀", "<|endoftext|>", "ª", "µ", "×", "÷", "the", "Tion"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert enc.ids(text).tolist() == library(text), repr(text)


def test_columns_equal_the_library(library):
    rng, enc = random.Random(7), encoder(tokenizer_path())
    words = ["the", "The,", "don't", "x1", "éclair.", "ÉCLAIR", "漢字", "--", "a" * 90, "b-c", "END|>", "<|EndOfText|>", "ok...", "ok.,no"]
    texts = [None if rng.random() < 0.05 else rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(400)]
    ids, ends = enc.column(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library(t) for t in texts]
    assert [x.tolist() for x in np.split(*(lambda i, e: (i, e[:-1]))(*enc.column(pa.array(texts * 2, pa.string()))))] == [library(t) for t in texts * 2]
    assert len(enc.column(pa.array([], pa.string()))[1]) == 0 and enc.fast


def test_more_pieces_than_are_remembered(library, monkeypatch):
    from prosemill.llm import tokens

    monkeypatch.setattr(tokens, "PIECES_MOST", 64)
    enc, rng = tokens.WordEncoder(tokenizer_path()), random.Random(1)
    for _ in range(5):
        texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".", "1"]) for _ in range(50)) for _ in range(20)]
        ids, ends = enc.column(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library(t) for t in texts]
    assert enc.kept == enc.listed <= 64


def test_another_tokenizer_encodes_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    enc, other = encoder(path), Tokenizer.from_file(path)
    texts = ["Two  words, kept.", None, "é <|endoftext|> x"]
    ids, ends = enc.column(pa.array(texts))
    assert not enc.fast and [x.tolist() for x in np.split(ids, ends[:-1])] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_store_round_trip(spark, odd, library):
    path = shared_dir(spark)
    store.write_store(odd, path)
    got = {(r.doc_id, r.start): r for r in store.verify(spark, path).collect()}
    texts = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    want = []
    for doc, text in texts:
        ids = np.array([*library(text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got.values()), key=repr) == sorted(want, key=repr)
    ids = {(r.doc_id, r.start): np.frombuffer(r.ids, "<u2").tolist() for r in store.read_documents(spark, path).collect()}
    assert [ids[d, s] for d, s, _, _ in want] == [[*library(t), 2] for _, t in texts]


def test_chunks_stored_once_and_damage_found(spark):
    docs = spark.createDataFrame([(i, "one shared passage of words that repeats " * 400) for i in range(9)], "doc_id long, text string")
    path = shared_dir(spark)
    store.write_store(docs, path)
    chunks = spark.read.parquet(f"{path}/staged").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("deal").distinct().count()
    assert len({tuple(r.addresses) for r in spark.read.parquet(f"{path}/recipes").collect()}) == 1
    recipes = spark.read.parquet(f"{path}/recipes")
    bad = spark.createDataFrame([{**r.asDict(), "root": b"x" * 32} for r in recipes.collect()], recipes.schema)
    bad.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="damaged"):
        store.verify(spark, path).collect()
    spark.read.parquet(f"{path}/top").withColumn("tokens", store.F.lit(1).cast("long")).write.parquet(f"{path}/wrong")
    spark.read.parquet(f"{path}/wrong").write.mode("overwrite").parquet(f"{path}/top")
    with pytest.raises(ValueError, match="manifest"):
        store.read_recipes(spark, path)


def test_chunks_are_checked_without_a_tokenizer(spark, corpus):
    path = shared_dir(spark)
    store.write_store(corpus.limit(20), path)
    assert "tokenizer" not in inspect.signature(store.read_chunks).parameters
    assert store.read_chunks(spark, path).where("n < 1 or crc is null").count() == 0


def test_texts_taken_apart_at_once_are_bounded(library):
    encode = encoder(tokenizer_path())
    texts = pa.array([f"some words of text number {i} " * 40 for i in range(1000)])
    runs = [(i, j) for i, j, _, _ in encode.parts(texts)]
    assert max(sum(len(t) for t in texts.slice(i, j - i).to_pylist()) for i, j in runs) <= 1 << 18
    assert encode.column(texts)[0].tolist() == [x for t in texts.to_pylist() for x in library(t)]


def test_cuts_of_a_batch_are_those_of_each_document():
    rng = np.random.default_rng(4)
    gear = store._gear(50_000)
    docs = [rng.integers(0, 50_000, n).astype(np.uint16) for n in (1, 70, 30_000, 5, 9000)] + [np.full(10_000, 7, np.uint16)]
    ends = np.cumsum([len(d) for d in docs])
    got = store.cuts(np.concatenate(docs), ends, gear)
    assert [[x - (e - len(d)) for x in own] for own, e, d in zip(got, ends, docs)] == [store.cuts(d, np.array([len(d)]), gear)[0] for d in docs]
    assert all(own[-1] == e for own, e in zip(got, ends)) and max(np.diff(got[2])) <= store.CHUNK_MOST


def test_crc_of_parts():
    data = np.random.default_rng(1).integers(0, 2**32, 5000, np.uint32)
    at = [0, 1, 700, 4096, 5000]
    crcs = np.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(at, at[1:])], np.uint32)
    assert np.bitwise_xor.reduce(store.crc_shifted(crcs, np.array([5000 - b for b in at[1:]]))) == zlib.crc32(data.tobytes())


def test_store_of_nothing(spark, empty):
    path = shared_dir(spark)
    store.write_store(empty, path)
    assert store.verify(spark, path).count() == 0


def test_packing(spark, odd, library):
    packed = pack(odd)
    rows = digests(packed).collect()
    texts = [(r.doc_id, [*library(r.text), 1]) for r in odd.collect()]
    assert sum(r.length for r in rows) == sum(len(t) for _, t in texts)
    want = sorted((d, k, at, len(t[at : at + 4096]), zlib.crc32(np.array(t[at : at + 4096], "<u4").tobytes())) for d, t in texts if d is not None for k, at in enumerate(range(0, len(t), 4096)))
    assert sorted(tuple(r)[:5] for r in rows if r.doc_id is not None) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in rows) // 4096)
    joined = {r.sequence_id: r for r in sequences(packed).collect()}
    assert all(len(joined[s].ids) == 2 * sum(x for _, x in parts) for s, parts in by.items())


def test_packing_of_nothing(empty):
    assert digests(pack(empty)).count() == 0


def test_sum_of_squares_is_tight_and_valid():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4095, rng.lognormal(6, 1, 4000).astype(int) + 1)
    bins, offsets = sum_of_squares(lengths, 4096)
    used = np.bincount(bins, lengths)
    assert used.max() <= 4096 and len(used) <= -(-lengths.sum() // 4096) * 1.01 + 1
    assert len({(b, o) for b, o in zip(bins, offsets)}) == len(lengths)


def test_query(spark, library):
    rows = {r.doc_id: r for r in store.op1_token_store(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for d in docs:
        ids = np.array([*library(d.text), 2], "<u4")
        assert tuple(rows[d.doc_id]) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
