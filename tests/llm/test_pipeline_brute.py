"""The whole pipeline against one brute-force chain: SQL for the rules and the benchmark, all pairs, all windows, the tokenizer's library."""

import random

import corpus_pipeline
import duckdb
import pandas as pd

from tests.llm import data
from tests.llm.test_bpe_sharding import library
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_suffix_dedup import brute as repeated
from tramline.llm import queries


def corpus(seed: int = 9) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghiklmnoprst") for _ in range(r.randint(3, 8)))
    item = " ".join(word() for _ in range(20))
    passage = " ".join(word() for _ in range(70))
    texts = []
    for k in range(40):
        w = [word() for _ in range(r.randint(40, 160))]
        t = " ".join(w)
        if k % 4 == 1:
            t = f"{t[:200]} {passage} {t[200:]}"
        if k % 10 == 3:
            t = f"{t} {item} é"
        texts.append(t)
        if k % 5 == 2:
            texts.append(t)
            texts.append(t + " " + word())
    texts += [None, "", "too short", " \n\t", "ab " * 80, ("é" * 5 + " ") * 90 + passage]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows, [(1, item), (2, " ".join(word() for _ in range(30))), (3, None)]


def told_plainly(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    db = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    benchmark = pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    keep = {x[0] for x in db.execute(f"SELECT doc_id FROM ({queries.OP3_SQL}) AS q WHERE kept").fetchall()}
    first = brute_kept([r for r in rows if r[0] in keep])
    own = sorted(first)
    cut = []
    for (i, t), flags in zip(own, repeated([(t or "").encode() for _, t in own]), strict=True):
        raw, parts, at = (t or "").encode(), [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and flags[end] == flags[at]:
                end += 1
            if not flags[at]:
                parts.append(raw[at:end].decode(errors="ignore"))
            at = end
        cut.append((i, "".join(parts)))
    documents = pd.DataFrame(cut, columns=["doc_id", "text"])
    bad = {x[0] for x in db.execute(f"SELECT doc_id FROM ({queries.OP4_SQL}) AS q WHERE contaminated").fetchall()}
    enc = library()
    return [(i, enc.encode_ordinary(t)) for i, t in cut if i not in bad]


def test_pipeline_as_told_plainly(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, data.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = told_plainly(rows, items)
    assert got == want
    assert 20 < len(want) < len(rows) - 15
