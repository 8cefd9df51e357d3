import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm import data
from tramline.llm import queries, token_files
from tramline.llm.shared import filesystem


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows, end=2):
    t, at, out = library(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def tokenizer():
    return token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), 2)


def test_elias_fano_gives_every_number_back():
    r = random.Random(1)
    for values in ([], [0], [5], [0, 0, 0], [1 << 62], sorted(r.randrange(1 << 40) for _ in range(3000)), sorted(r.randrange(50) for _ in range(3000)), list(range(1000)), [0] * 700 + [1 << 50]):
        e = token_files.EliasFano.frombytes(token_files.EliasFano.encode(np.array(values, np.uint64)).tobytes())
        assert e.slice(0, len(values)).tolist() == values
        assert [e.get(i) for i in range(len(values))] == values
        for _ in range(20 if values else 0):
            i, j = sorted(r.randrange(len(values) + 1) for _ in range(2))
            assert e.slice(i, j).tolist() == values[i:j]
    dense = token_files.EliasFano.encode(np.cumsum(np.full(100_000, 300)))
    assert len(dense.tobytes()) * 8 / 100_000 < 12  # 2 + log2(300) bits and samples, not 64


def test_pieces_are_encoded_as_whole_texts(monkeypatch):
    r, t, own = random.Random(2), library(), tokenizer()
    points = [*"abcXYZ\xe9\xdf\xf1'\u2019.,;:!?-()0123 \n\t\x85\xa0\u2028\u3000\u1680\u2003\u202f\u205f\x0b\x0c\x1c\x1f\x00\u0301\u0130\u65e5\u672c\U0001f600<|>", "'s", "'re", "<|endoftext|>", "\ufb01", "\u01c4", "e\u0301.", "end.of", "it's.", "..."]
    texts = ["".join(r.choice(points) for _ in range(r.randrange(60))) for _ in range(1500)]
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    coded = [raw for i in range(0, len(texts), 100) for raw in own.encode(texts[i : i + 100])]
    for text, raw in zip(texts, coded, strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], text


def test_runs_of_a_word_are_encoded_as_the_word():
    r, t, own = random.Random(5), library(), tokenizer()
    words = [f"{a}{chr(c)}{b}" for c in [*range(1, 0x250), 0x300, 0x307, 0x338, 0x2019, 0x212A, 0x212B, 0x1E9E, 0xFF21, 0x1D7D8] for a, b in (("ab", "cd"), ("Ab.", ""), ("", "7X"), ("1", "'s"))]
    points = [*"abXY\xe9\xc9\xd7\xf7\u0130\u0250'.,#$%&*-0123<>| \n", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = [*words, " ".join(words), *("".join(r.choice(points) for _ in range(r.randrange(1, 30))) for _ in range(3000)), "", None, " ", "\x85"]
    column = pa.array(["left out", *texts, "left out"], pa.string()).slice(1, len(texts))
    for text, raw in zip(texts, own.encode_column(column).to_pylist(), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], text


def test_the_library_sees_a_run_once(monkeypatch):
    own, seen = tokenizer(), []
    own._load()
    monkeypatch.setattr(own, "_young", {})
    monkeypatch.setattr(own, "_old", {})
    monkeypatch.setattr(own, "_encoded", lambda pieces, encoded=own._encoded: seen.extend(pieces) or encoded(pieces))
    own.encode(["Tram### tram%%%", "TRAM12 (tram), tr\xe1m.", "don't, tram21###"])
    own.encode(["tram,### TRAM### 2###1"])
    assert sorted(seen) == sorted(["tram", "###", "%%%", "1", "2", "(", "),", "tr\xe1m", ".", "don't,", ",###"])


def test_files_as_brute_force(spark):
    df = data.frame(spark, awkward=True)
    folder = token_files.write_files(df, tokenizer(), roll=2000)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, folder).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    files = spark.read.parquet(f"{folder}/manifest").orderBy("start").collect()
    assert len(files) > 5 and sum(f.n_docs for f in files) == len(rows)
    whole = {r.start: list(r.ids) for r in token_files.read_files(spark, folder, ids=True).collect()}
    system, path = filesystem(folder)
    for f in files[:6]:
        one = token_files.TokenFile(system, f"{path}/{f.name}")
        k = len(one) // 2
        assert one.document(k).tolist() == whole[f.start + int(one.bounds(k, k + 1)[0])]


def test_empty_negative_and_far_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_files(spark, token_files.write_files(none, tokenizer())).count() == 0
    rows = [(-(1 << 40), "a b"), (1 << 61, None), (5, ""), (None, "x"), (None, None)]
    folder = token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer())
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_files.read_files(spark, folder).collect()))
    assert [r[1] for r in got] == [-(1 << 40), 5, 1 << 61, None, None]


def test_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.op11_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
