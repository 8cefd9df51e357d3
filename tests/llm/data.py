"""Documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 7))) for _ in range(80)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(70)
    out: list[str | None] = [None, "", " \n\t ", "a", "one two", "x" * 500, "ab " * 400, prose(4000)]
    for _ in range(n):
        t = prose(r.randint(1, 120)).capitalize()
        if r.random() < 0.3:
            t = f"{t}\n{passage}\n{prose(5)}"
        if r.random() < 0.2:
            t = "\n".join([t, "Buy now! ### $$$", "Buy now! ### $$$", t])
        out.append(t)
    out += [out[-1], out[-2], out[10], out[11] + " z", "q " + out[12], out[13][:-3], "日本語 text 😀 " * 30]
    return out


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts(seed, n))]


def frame(spark, seed: int = 1, n: int = 60, awkward: bool = False):
    """``awkward`` adds a repeated row, two rows with one id, a null id, and columns with clashing names."""
    from pyspark.sql import functions as F

    own = rows(seed, n)
    if awkward:
        own += [own[20], (21, "another text under the same id", "de", None, None), (None, own[9][1], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(own, SCHEMA)
    if awkward:
        for c in ("id", "key", "shard", "slot", "law", "size", "fp", "tie", "h", "rule", "words", "score", "component_id", "n_words", "kept"):
            df = df.withColumn(c, F.lit("clash"))
    return df
