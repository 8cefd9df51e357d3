import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm import data
from tramline.llm import bpe, queries, sharding


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_the_library(spark):
    df = data.frame(spark, awkward=True)
    v, enc = queries.vocabulary(), library()
    coded = bpe.decode(bpe.encode(df, v), v)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in coded.collect()), key=str)
    want = sorted(((r.doc_id, enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in df.collect()), key=str)
    assert got == want
    assert bpe.encode(df.limit(0), v).count() == 0


def test_long_and_odd_words(spark):
    v, enc = queries.vocabulary(), library()
    r = random.Random(1)
    words = ["a" * 3000, "".join(r.choice("abcdefgh") for _ in range(900)), "é" * 500, "<|endoftext|>", "  \n\n x", "don't we'll", "\x00\x01", "123456789" * 50]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {x.doc_id: list(x.ids) for x in bpe.encode(df, v).collect()}
    assert got == {i: enc.encode_ordinary(w) for i, w in enumerate(words)}


def test_small_chunks_and_large_ids(spark, monkeypatch):
    v, enc = queries.vocabulary(), library()
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 300)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    rows = [((1 << 60) + 1 + i if i % 5 else None, t) for i, t in enumerate(data.texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coded = bpe.encode(df, v, with_bytes=True)
    got = sorted(((x.doc_id, list(x.ids), bytes(x.bytes)) for x in coded.collect()), key=str)
    assert got == sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)


def test_every_word_is_encoded_once_and_none_may_be_missing(spark):
    import pytest

    v = queries.vocabulary()
    names = spark.createDataFrame([(c, n, w) for c in (4, 9) for n, w in enumerate(["the", " cat", " the", "zzzq"])], "chunk long, no int, word string")
    back = {}
    for r in bpe.encoded_words(names, v).collect():
        words = bpe._Words([(r.nos, r.sizes, r.ids)], v.kind) if len(bpe._unpacked(r.nos)) == 4 else None
        back.setdefault(r.chunk, []).append((r.nos, r.sizes, r.ids))
        assert words is None or words.size.tolist() == [len(v.encode_word(w)) for w in (b"the", b" cat", b" the", b"zzzq")]
    assert sorted(back) == [4, 9]
    whole = bpe._Words(back[4], v.kind)
    assert whole.ids(bpe._packed(np.array([3, 0]))).tolist() == v.encode_word(b"zzzq") + v.encode_word(b"the")
    with pytest.raises(ValueError, match="did not come back"):
        bpe._Words([], v.kind).ids(bpe._packed(np.array([0])))


def brute_shards(rows, n):
    rows = sorted(rows)
    total, at, out, slots = sum(r[1] for r in rows), 0, {}, [0] * n
    for i, size in rows:
        s = min(n - 1, at * n // total)
        out[i] = (s, slots[s])
        slots[s] += 1
        at += size
    return out


def test_shards_as_brute_force(spark):
    r = random.Random(2)
    rows = [(i * 7 % 20011 - 5000, r.choice([8, 9, 30, 5000])) for i in range(20000)]
    df = spark.createDataFrame(rows, "k long, size long")
    for most in (200_000, 150):
        got = {x.k: (x.shard, x.slot) for x in sharding.assign_shards(df, 24, "k", "size", most).collect()}
        assert got == brute_shards(rows, 24)


def test_shards_split_one_key(spark):
    rows = [(5, 10)] * 3000 + [(None, 10)] * 50 + [(i, 10) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, size long")
    got = sharding.assign_shards(df, 24, "k", "size", 400).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1


def test_shards_awkward(spark):
    df = data.frame(spark, awkward=True).selectExpr("*", "cast(coalesce(octet_length(text), 0) + 8 as long) as bytes_")
    got = sharding.assign_shards(df, 24, "doc_id", "bytes_")
    assert got.count() == df.count() and got.filter("law <> 'bytes'").count() == 0
    assert sharding.assign_shards(df.limit(0), 24, "doc_id", "bytes_").count() == 0
    assert sharding.assign_shards(df.limit(3), 24, "doc_id", "bytes_").count() == 3


def test_query_columns(spark):
    got = queries.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = brute_shards([(i, len((t or "").encode()) + 8) for i, t in docs.items()], 24)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", *want[r.doc_id], None)


def test_bpe_query_digests(spark):
    enc = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op5_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


def test_plain_pattern_finds_the_same_words():
    import random

    import public_tokenizers
    import regex

    from tramline.llm import bpe

    plain = bpe.plain_pattern(public_tokenizers.PATTERN)
    points = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(points) + draw.choice(["", "", " ", "a", "1", "'s", "\n", "  "]) for _ in range(300))
        assert bpe.OTHER.search(text) is None
        assert bpe.re.findall(plain, text) == regex.findall(public_tokenizers.PATTERN, text)
    assert bpe.plain_pattern(r"\w+") is None
