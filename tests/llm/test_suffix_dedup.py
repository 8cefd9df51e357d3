import hashlib
import random

import numpy as np
import pytest

from tests.llm import data
from tramline.llm import suffix_dedup as sd


def brute(docs):
    """docs in order: texts as bytes -> removed flags."""
    seen, out = {}, []
    for t in docs:
        flags = bytearray(len(t))
        for q in range(len(t) - sd.LENGTH + 1):
            w = t[q : q + sd.LENGTH]
            if w in seen:
                flags[q : q + sd.LENGTH] = b"\1" * sd.LENGTH
            seen[w] = True
        out.append(bytes(flags))
    return out


def check(spark, own, **more):
    df = spark.createDataFrame(own, "doc_id long, text string")
    got = {r.doc_id: r for r in sd.dedup(df, **more).collect()}
    order = sorted(own)
    flags = brute([(t or "").encode() for _, t in order])
    for (i, t), f in zip(order, flags, strict=True):
        raw, r = (t or "").encode(), got[i]
        kept = bytes(b for b, x in zip(raw, f, strict=True) if not x)
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(raw), sum(f), kept), i
        assert len(r.spans) == len([x for x in f.split(b"\0") if x])


def near_copies(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcd é") for _ in range(5)) for _ in range(40)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(4)]
    out = []
    for i in range(60):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("xyz")
        cut = r.randrange(len(t))
        out.append((i * 3, "".join(t[cut:] + t[:cut]) if i % 3 else "".join(t)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    check(spark, [(r[0], r[1]) for r in data.rows(seed)])
    check(spark, near_copies(seed))


def test_crowded_grams_go_window_by_window(spark):
    check(spark, near_copies(5), most=2)


def test_collection_order():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(0, 40))) for _ in range(50)]
    string, size, lcp = sd.collection_order(strings)
    suffixes = [(s[len(s) - n :], k) for k, s in enumerate(strings) for n in range(len(s) + 1)]
    got = [(strings[k][len(strings[k]) - n :], k) for k, n in zip(string, size, strict=True)]
    assert got == sorted(suffixes)
    for (a, _), (b, _), x in zip(got, got[1:], lcp[1:], strict=False):
        n = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert x == n


def test_every_window_has_one_pick():
    r = random.Random(4)
    t = bytes(r.choice(b"abc") for _ in range(3000)) + b"z" * 300
    with np.errstate(over="ignore"):
        _, start, shape, _, _ = sd.picks([t], sd._Hasher(1 << 12))
    times = np.zeros(len(t), int)
    for a, n in zip(start, shape // sd.WINDOW, strict=True):
        times[a : a + n - sd.LENGTH + 1] += 1
    assert (times[: len(t) - sd.LENGTH + 1] >= 1).all()
    assert (times[: 3000 - sd.LENGTH + 1] == 1).mean() > 0.99


def test_awkward_rows(spark):
    df = data.frame(spark, awkward=True)
    got = sd.dedup(df).collect()
    assert len(got) == df.count()
    assert sum(r.doc_id is None for r in got) == 2
    twice = [r for r in got if r.doc_id == 20]
    n = len((df.filter("doc_id = 20").first().text).encode())
    assert len(twice) == 2 and (n < 100 or max(r.n_removed for r in twice) == n)
    empty = sd.dedup(df.limit(0))
    assert empty.count() == 0


def test_text_without_halved_characters(spark):
    own = [(1, "é" * 80 + "a"), (2, "a" + "é" * 80)]
    df = spark.createDataFrame(own, "doc_id long, text string")
    for r in sd.dedup(df, as_text=True).collect():
        r.kept.encode()
        assert "�" not in r.kept


def test_digest_of_untouched(spark):
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in sd.dedup(df).collect()}
    assert got == {1: hashlib.sha256(b"short").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
