"""Directly addressable codes: bit for bit, file by file and as a table."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from mailsift.llm import queries, token_files
from mailsift.storage import new_path


@pytest.mark.parametrize("high", [1, 256, 257, 49_408, 1 << 24, 1 << 32])
def test_any_token_is_read_alone(high):
    rng = np.random.default_rng(high % 1000)
    ids = np.where(rng.random(3000) < 0.5, rng.integers(0, high, 3000), rng.integers(0, min(high, 300), 3000)).astype(np.uint32)
    counts = [0, 1, 700, 0, 2299]
    file = token_files.TokenFile(token_files.pack_file(3, 7, [None, -5, 2, 2, 9], counts, ids))
    assert [file.token(i) for i in range(len(ids))] == ids.tolist()
    assert (file.range, file.place, file.n_ids, file.null.tolist()) == (3, 7, 3000, [1, 0, 0, 0, 0])
    for _ in range(300):
        a, b = sorted(rng.integers(0, 3001, 2).tolist())
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    assert [file.document(i).tolist() for i in range(5)] == [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    for place in (-1, 3000):
        with pytest.raises(IndexError):
            file.token(place)


def test_a_file_without_ids_and_one_that_is_none():
    assert token_files.TokenFile(token_files.pack_file(0, 0, [4], [0], np.empty(0, np.uint32))).tokens(0, 0).tolist() == []
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 100)


def test_reading_one_token_decodes_no_block():
    """Bytes of the bitmap outside the token's block, and all other chunks, may be anything."""
    ids = np.arange(5000, dtype=np.uint32) * 7
    data = bytearray(token_files.pack_file(0, 0, [1], [5000], ids))
    file = token_files.TokenFile(bytes(data))
    chunks_at = bytes(data).index(file.levels[0][0].tobytes())
    i = 2600
    for j in range(5000):
        if j != i:
            data[chunks_at + j] ^= 255
    bitmap_at = chunks_at + 5000
    for j in [*range(0, 2560 // 8), *range(3072 // 8, 5000 // 8)]:
        data[bitmap_at + j] ^= 255
    assert token_files.TokenFile(bytes(data)).token(i) == ids[i]


def texts():
    rng = random.Random(11)
    made = [None, "", " \n", "one", "Éa ñandú " * 40, "x" * 5000, "<|endoftext|> a", "漢字 かな 한글 " * 20]
    made += [" ".join(rng.choice(["alpha", "Beta", "g4mma", "de'lta", "1,234.5", "…"]) for _ in range(rng.randrange(1, 400)))
             for _ in range(60)]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    made = texts()
    rng = random.Random(2)
    keys = [*range(-3, len(made) - 3)]
    rng.shuffle(keys)
    rows = [(k, t, "x", 1) for k, t in zip(keys, made)]
    rows += [(None, "no key", "y", 2), (None, None, None, 3), (5, "a second text of key 5", None, 4)]
    rows += [(7, "the same row " * 30, None, 5)] * 40  # one key with a third of all rows
    # columns whose names the operator uses inside
    return spark.createDataFrame(rows, "doc_id long, text string, `range` string, n_tokens long").repartition(5)


@pytest.mark.parametrize("range_chars, file_ids", [(10**9, 10**9), (4000, 900), (300, 50)])
def test_round_trip(spark, docs, range_chars, file_ids):
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary()
    tokenizer = Tokenizer.from_file(vocabulary)
    path = new_path(spark, "token-test")
    token_files.write(docs, path, vocabulary, range_chars=range_chars, file_ids=file_ids)
    got = sorted(token_files.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0,
                   [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    assert [r["doc_id"] for r in got] == [k if known else None for known, k, _ in want]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    every = [i for r in got for i in r["ids"]]
    places = random.Random(1).sample(range(at), 200) + [0, at - 1]
    wanted = spark.createDataFrame([(p,) for p in [*places, -1, at, at + 10**9]], "start long")
    found = {r["start"]: r["id"] for r in token_files.tokens_at(spark, path, wanted).collect()}
    assert found == {p: every[p] for p in places}
    files = spark.read.parquet(f"{path}/{token_files.STARTS}").count()
    assert files == 1 if file_ids == 10**9 else files > 10


def test_one_key_makes_many_ranges(spark, docs):
    rows = token_files._rows(docs, "doc_id", "text")
    bounds = token_files._bounds(rows, 2000)
    assert sum(b[0] == 7 for b in bounds) > 2


def test_empty_table(spark, docs):
    assert token_files.encoded_documents(docs.where("false"), queries.vocabulary()).collect() == []
