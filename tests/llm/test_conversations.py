import hashlib
import heapq
import random
import zlib

import duckdb

from tramline.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_edits(rows):
    """Cheapest edits by a search over (cost, letters): rows are (role, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, letters, out
        add = lambda c, letter, j, to, what: heapq.heappush(heap, (cost + c, letters + letter, j, to, (*out, *what)))
        for name in ("user", "assistant"):
            if to := step.get((state, name[0])):
                add(3, "I", i, to, [(name, None)])
        if i < len(rows):
            role, fault = rows[i]
            add(4, "D", i + 1, state, [])
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if to := step.get((state, role[:1])):
                    add(extra, "K", i + 1, to, [(role, i)])
                for name in ("user", "assistant"):
                    if to := step.get((state, name[0])):
                        add(3 + extra, "R", i + 1, to, [(name, i)])
    raise AssertionError


def brute(rows, ids):
    by = {i: [] for i in ids}
    for c, turn, role, text in rows:
        by[c].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    blanks = " \t\n\x0b\x0c\r"
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, judged = set(), []
        for _, role, text in own:
            bare = text.rstrip(blanks)
            judged.append((role, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        cost, letters, kept = brute_edits(judged)
        lines = "\n".join(f"{role}:{'' if i is None else own[i][2]}" for role, i in kept)
        count = lambda f: sum(j[1] == f for j in judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talks(seed, conversations_=120, longest=9):
    r = random.Random(seed)
    texts = ["", " \t", "Yes.", "No!", "cut off", "Why? ", "x.y", "a\nb?\n", "é…", "long " * 300 + "."]
    rows = []
    for c in range(conversations_):
        turn = r.randrange(-2, 3)
        for _ in range(r.randrange(1, longest)):
            rows.append((c, turn if r.random() > 0.02 else None, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Sys"]), r.choice(texts) if r.random() < 0.6 else f"{r.random()}."))
            turn += r.choice([1, 1, 1, 3])
    nulls = set()
    return [x for x in rows if x[1] is not None or (x[0] not in nulls and not nulls.add(x[0]))]  # one null turn each, so that no order is open


def check(spark, rows, ids, size=1 << 16):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", queries.F.lit("clash")).repartition(5)
    known = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    got = conversations.repair(df, known, size=size)
    assert got.columns == COLUMNS
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, ids)


def test_repair_as_brute_force(spark):
    rows = talks(1)
    rows += [(None, 1, "user", "one."), (None, 2, None, "two."), (None, 3, "assistant", None), (500, None, "user", "alone")]
    rows += [(501, 4, "user", "twice.")] * 3
    check(spark, rows, [*range(120), None, 500, 501, 777])


def test_long_conversations_in_small_chunks(spark):
    rows = talks(2, 6, 400)
    for size in (1, 7):
        check(spark, rows, range(6), size)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(none, none).count() == 0
    got = conversations.repair(none, spark.createDataFrame([(1,), (1,)], "conv_id long")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_are_whole_conversations(spark):
    import re

    seen = conversations.faults(spark.createDataFrame(talks(3), SCHEMA))
    edits = conversations.letters(conversations.chunks(conversations.judged(seen), 3))
    by = {}
    for r in conversations.repaired(seen, edits).orderBy("k", "seq").collect():
        by.setdefault(r.k, []).append(r)
    assert by and all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in own)) and [r.seq for r in own] == list(range(len(own))) for own in by.values())


def test_query_as_its_sql_and_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = sorted((tuple(r) for r in queries.op12_conversation_repair(spark, sf).collect()), key=str)
    assert got == sorted(db.execute(queries.OP12_SQL).fetchall(), key=str)
    rows, ids = [], []
    for c, t, role, text in db.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        ids.append(c)
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        if hit:
            text = "" if hit == 1 else "".join(x for x in text if x not in ".!?") if hit == 2 else text
            rows += [(c, t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    assert got == brute(rows, ids)
