import random
import zlib
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import zstandard
from corpus import EDGES, edge_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlog.llm import token_files

MODEL = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "B", "word", "'s", "'RE", " ", "\t", "\n", "\v", "\f", "\r", "\x85", " ", " ", "\x00", "\x1c", "é", "é", "́", "Σ", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "1", "23", "!?", ",", ".", "×", "÷", "Ã", "$$$", "x<", "中", "ᄀ", "ᅡ", "ẞ", "​", "\U0001f600", "</w>"]


@cache
def model():
    return Tokenizer.from_file(MODEL)


def plain(text):
    """The ids of a whole text and the end id."""
    return [*model().encode(text or "", add_special_tokens=False).ids, 2]


def encoded(encoder, texts):
    """The ids of each text."""
    data = [(text or "").encode() for text in texts]
    bounds = np.concatenate(([0], np.cumsum([len(part) for part in data])))
    ids, upto = encoder.encode(np.frombuffer(b"".join(data), np.uint8), bounds)
    return [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])]


def test_words_give_the_ids_of_whole_texts():
    draw = random.Random(5)
    texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 12))) for _ in range(4000)] + [None, "", "x " * 5000]
    encoder = token_files.WordEncoder(Path(MODEL).read_text())
    assert encoder.by_words and encoder.by_cores
    bare = [text for text in texts if "<|" not in (text or "")]
    for some in (texts, bare, bare, [None, ""]):
        assert encoded(encoder, some) == [plain(text)[:-1] for text in some]


def test_a_tokenizer_that_joins_words_gets_whole_texts():
    other = Path(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = token_files.WordEncoder(other.read_text())
    assert not encoder.by_words
    texts = ["One two,  three\n\nfour", None, " x"]
    expected = Tokenizer.from_file(str(other)).encode_batch([text or "" for text in texts], add_special_tokens=False)
    assert encoded(encoder, texts) == [found.ids for found in expected]


def test_edges(spark):
    path = token_files.write_shards(edge_documents(spark), MODEL, 2)
    rows = token_files.with_starts(token_files.read_shards(spark, path)).collect()
    key = lambda pair: (pair[0] is None, pair[0] or 0)
    found = sorted(((row.doc_id, row.start, np.frombuffer(row.ids, "<u4").tolist()) for row in rows), key=lambda row: row[1])
    assert [key(row) for row in found] == sorted(map(key, EDGES))
    at = 0
    for _, start, ids in found:
        assert start == at
        at += len(ids)
    assert sorted((str(doc), ids) for doc, _, ids in found) == sorted((str(doc), plain(text)) for doc, text, *_ in EDGES)
    sums = token_files.with_checksums(token_files.read_shards(spark, path)).select("n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, sums)) == sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in (plain(text) for _, text, *_ in EDGES))


def test_frames_shards_and_fetch(spark, monkeypatch):
    """Many small frames and shards: order, starts and single documents."""
    monkeypatch.setattr(token_files, "FRAME_IDS", 50)
    writer = token_files.ShardWriter(2, 3, 1)
    docs = [(i if i % 7 else None, np.arange(i * 9 % 170, dtype="<u2")) for i in range(60)]
    for doc, ids in docs:
        writer.add(doc, ids.tobytes())
    data = writer.finish() + b"\xb1\xea\x92\x8f"
    shard = token_files.Shard.of(data)
    assert (shard.partition, shard.piece) == (3, 1)
    assert len(shard.entries) > 40
    for place, (doc, ids) in enumerate(docs):
        assert shard.document(place).tolist() == ids.tolist()
        assert (None if shard.is_null[place] else shard.doc_ids[place]) == doc
    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a:b]) for a, b in zip(shard.places[:-2], shard.places[1:-1]))
    assert whole == b"".join(ids.tobytes() for _, ids in docs)


def test_only_the_frames_of_a_document_are_read():
    writer = token_files.ShardWriter(2, 0, 0)
    docs = [np.full(60_000, i, "<u2") + np.arange(60_000, dtype="<u2") % 100 for i in range(4)]
    for i, ids in enumerate(docs):
        writer.add(i, ids.tobytes())
    data = bytearray(writer.finish() + b"\xb1\xea\x92\x8f")
    places = token_files.Shard.of(bytes(data)).places
    data[int(places[1]) + 30] ^= 0xFF
    read = []

    def part(at, n):
        read.append((at, n))
        return bytes(data[at : at + n])

    shard = token_files.Shard(part, len(data))
    read.clear()
    assert shard.document(2).tolist() == docs[2].tolist()
    assert read == [(int(places[2]), int(places[3] - places[2]))]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        shard.document(1)
    with pytest.raises(ValueError, match="seek table"):
        token_files.Shard.of(bytes(data[:-3]))


def test_fetch(spark):
    docs = edge_documents(spark)
    path = token_files.write_shards(docs, MODEL, 2)
    wanted = spark.createDataFrame([(7,), (1,), (7,), (99,), (None,)], "doc_id long")
    found = sorted((row.doc_id, np.frombuffer(row.ids, "<u4").tolist()) for row in token_files.fetch(spark, path, wanted).collect())
    assert found == sorted((doc, plain(text)) for doc, text, *_ in EDGES if doc in (1, 7))
    assert token_files.document_table(spark, path).agg(F.sum("n_tokens")).first()[0] == sum(len(plain(text)) for _, text, *_ in EDGES)


def test_empty(spark):
    path = token_files.write_shards(edge_documents(spark, []), MODEL, 2)
    assert token_files.with_starts(token_files.read_shards(spark, path)).count() == 0
