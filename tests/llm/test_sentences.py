"""The sentencepiece encoder and decoder against the library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cueloom.llm import queries, sentences, vocab

PATH = vocab.default_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string, n_tokens string"
TEXTS = ["Hello world, it's a test of words.", "", None, "  two  spaces \n\tx ", " ", "   ", "▁", "a▁b ▁ c▁▁", "日本語 テキスト é ﬁ 😀 \U0010ffff", "a" * 700, "x " * 3000, "</s> <s> <unk> <0x0A> ▁<s>",
         "don't stop 123 4567", "Hello world, it's a test of words.", "ünïcode ßtraße — “q” z", "tab\tand\x00null\x7f", "internationalisation" * 300, "\n\n\n", "é ​﻿ 　wide", "ab" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash", "clash"), (None, "no id", "clash", "clash")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("blocks", [{}, {"block_chars": 50, "row_chars": 20, "buckets": 3}])
def test_encoding_is_the_library(docs, blocks):
    library = sentences.vocabulary(PATH).library
    got = sentences.encode(docs, **blocks).withColumn("text", sentences.decode("ids")).collect()
    want = [(r.doc_id, library.encode(r.text or "")) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert all(r.text == library.decode(r.ids) for r in got)


def test_agenda_of_random_units():
    own = sentences.vocabulary(PATH)
    rng = random.Random(3)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "eainrst", "0123456789.,-", "éèàüß", "漢字かなカナ", "them "):
        for _ in range(300):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
            assert [i for u in own.units(text) for i in own.encoded(u)] == own.library.encode(text), text


def test_decoding_of_any_ids(spark):
    """Lists that no text encodes to: broken characters, control and unknown ids, spaces anywhere."""
    own = sentences.vocabulary(PATH)
    rng = random.Random(4)
    space, byte = own.ids["▁"], own.bytes
    lists = [[], [1], [0], [1, 0, 2], [space], [space, space], [1, space, space], [byte[0x20], space], [byte[0xE3], byte[0x81]], [byte[0xE3], byte[0x81], byte[0x82], byte[0x82]],
             [byte[0xC3], own.ids["a"]], [byte[0xF0], byte[0x9F], byte[0x98], space], [byte[0xED], byte[0xA0], byte[0x80]], [byte[0xC0], byte[0x80]], [0, space], [2, 2, own.ids["▁the"]]]
    lists += [[rng.choice((rng.randrange(3), rng.randrange(3, 259), rng.randrange(259, 32_000))) for _ in range(rng.randrange(1, 12))] for _ in range(300)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "i int, ids array<int>").select("i", "ids", sentences.decode("ids").alias("text")).collect()
    for r in rows:
        assert r.text == (None if r.ids is None else own.library.decode(r.ids)), r.ids


def test_the_library_has_the_last_word(spark, monkeypatch):
    monkeypatch.setattr(sentences.Vocabulary, "encoded", lambda self, text: [0])
    with pytest.raises(ValueError, match="differ"):
        sentences._checked_ids(PATH)(["▁one", "▁two"])


def test_query(spark):
    library = sentences.vocabulary(PATH).library
    rows = {r.doc_id: r for r in queries.QUERIES["op12_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(rows) == len(texts)
    for d in texts:
        ids = library.encode(d.text)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_no_documents(docs):
    assert sentences.encode(docs.limit(0)).count() == 0
