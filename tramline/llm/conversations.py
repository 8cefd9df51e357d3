"""Structure repair of conversations by the cheapest edits, the least edit string among ties.

A conversation's roles should read ``(s?(ua)+)?`` by their initials.  Its rows in order and the
four states of that pattern make a graph: a row is kept, given another role or deleted, and user or assistant
rows without text may be inserted anywhere.  Least costs from the start and to the end tell which arcs are tight, that is on
some cheapest way; a walk over the set of nodes that the letters so far can have reached takes the
least letter at each step.  All ways to one set have read the same rows, since only ``I`` reads none.

Rows are range-partitioned in order and packed into chunks of one byte a row, so a conversation may
hold any share of the rows: a chunk is a 4 x 4 table of least costs, and a chunk's walk a table from sets to sets
(16 of them), and only those tables of one conversation meet in a task.  Texts
move once, for the repaired rows; they stream past in order and are never held.

Rows of one turn are ordered by role, then by a hash of their text; null turns come first.  Null roles and texts
count as one space.  Equal rows of one turn are a row and its duplicates.  A null conversation id is a
conversation of its own.  Empty tables give no rows; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import BLANKS, drop_written, written

#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows in a chunk; no path costs as much as ``FAR``.
CHUNK, FAR = 1 << 16, 1 << 50
#: States of the pattern: nothing read, after s, after u, after a; the first and the last may end.
STATES, ENDS = range(4), (0, 3)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INITIALS, FINE, CUT, GONE = "?sua", 0, 1, 2
_ADDED = sorted([*NEXT["u"].items(), *NEXT["a"].items()])


def _arcs(kind: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of a row: its kind is four times its fault plus its role's initial."""
    fault, initial = divmod(kind, 4)
    out = [("D", q, q, DELETE) for q in STATES]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        out += [("K", q, t, extra) for q, t in NEXT.get(INITIALS[initial], {}).items()]
        out += [("R", q, t, REROLE + extra) for q, t in _ADDED]
    return out


ARCS = [_arcs(k) for k in range(12)]


def _closed(f: list[int]) -> list[int]:
    """Costs to reach a position's states, with inserts there."""
    two = min(f[2], min(f[0], f[1], f[3]) + INSERT)
    return [f[0], f[1], two, min(f[3], two + INSERT)]


def _closed_back(b: list[int]) -> list[int]:
    """Costs from a position's states to the end, with inserts there."""
    two = min(b[2], b[3] + INSERT)
    return [min(b[0], two + INSERT), min(b[1], two + INSERT), two, min(b[3], two + INSERT)]


START, END = _closed([0, FAR, FAR, FAR]), _closed_back([0, FAR, FAR, 0])


def _forward(f: list[int], kind: int) -> list[int]:
    out = [FAR] * 4
    for _, q, t, c in ARCS[kind]:
        out[t] = min(out[t], f[q] + c)
    return _closed(out)


def _backward(b: list[int], kind: int) -> list[int]:
    out = [FAR] * 4
    for _, q, t, c in ARCS[kind]:
        out[q] = min(out[q], c + b[t])
    return _closed_back(out)


def chunk_costs(kinds: bytes) -> list[int]:
    """Least costs through a chunk, from each state before its first row to each state after its last, as 16 numbers."""
    out = []
    for q in STATES:
        f = [0 if q == s else FAR for s in STATES]
        for k in kinds:
            f = _forward(f, k)
        out += [min(x, FAR) for x in f]
    return out


def through(f: list[int], costs: list[int]) -> list[int]:
    return [min(FAR, *(f[q] + costs[4 * q + t] for q in STATES)) for t in STATES]


def through_back(b: list[int], costs: list[int]) -> list[int]:
    return _closed_back([min(FAR, *(costs[4 * q + t] + b[t] for t in STATES)) for q in STATES])


class Walk:
    """The tight arcs of a chunk between costs from the start and to the end, and walks along them."""

    def __init__(self, kinds: bytes, before: list[int], after: list[int], total: int) -> None:
        fronts, backs = [before], [after]
        for k in kinds:
            fronts.append(_forward(fronts[-1], k))
        for k in reversed(kinds):
            backs.append(_backward(backs[-1], k))
        backs.reverse()
        self.steps: list[dict[str, list[tuple[int, int]]]] = []
        for i in range(len(kinds) + 1):
            f, b, tight = fronts[i], backs[i], {}
            for q, t in _ADDED:
                if f[q] + INSERT + b[t] == total:
                    tight.setdefault("I", []).append((q, t))
            for letter, q, t, c in ARCS[kinds[i]] if i < len(kinds) else ():
                if f[q] + c + backs[i + 1][t] == total:
                    tight.setdefault(letter, []).append((q, t))
            self.steps.append(tight)

    def run(self, nodes: int, last: bool) -> tuple[str, int]:
        """The least letters from a set of states (a bit each), and the set after them; ``last`` goes on to the end."""
        out, i, n = [], 0, len(self.steps) - 1
        while i < n or last:
            for letter in "DIKR":
                to = 0
                for q, t in self.steps[i].get(letter, ()):
                    if nodes >> q & 1:
                        to |= 1 << t
                if to:
                    break
            else:
                break  # the end: nothing is tight after the last row and its inserts
            out.append(letter)
            nodes, i = to, i + (letter != "I")
        return "".join(out), nodes


def faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows written with a key of their conversation (k), their place (turn, role, tie, row), and what they look like."""
    c = F.col(f"`{conv}`")
    own = rows.select(
        F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string"))).alias("k"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    own = own.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    own = own.withColumn("blank", last == "").withColumn("cut", ~last.isin(".", "!", "?") & (last != ""))
    same = F.concat(F.length("k"), F.lit(":"), "k", F.length("role"), F.lit(":"), "role", "text")
    return written(own.withColumn("same", F.unhex(F.sha2(same.cast("binary"), 256))), "turns")


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "tie", "row")


def judged(rows: DataFrame) -> DataFrame:
    """``faults`` rows without their texts, each with its first fault (blank, duplicate, truncated) and its kind."""
    narrow = rows.select("k", "turn", "role", "tie", "row", "blank", "cut", "same")
    first = narrow.groupBy("same").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    seen = narrow.join(first, "same", "left").withColumn("seen", F.coalesce(F.col("first") < _place(), F.lit(False)))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    grave = F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", CUT).otherwise(FINE)
    return seen.select("k", "turn", "role", "tie", "row", fault.alias("fault"), (grave * 4 + number).cast("byte").alias("kind"))


_ORDER = ("k", "turn", "role", "tie", "row")  # null turns come first


def chunks(kinds: DataFrame, size: int = CHUNK) -> DataFrame:
    """(part, seq, k, the place of the first row, kinds, costs, pairs): rows of one conversation in order, packed; written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, held = TaskContext.get().partitionId(), 0, None, bytearray()

        def done() -> tuple:
            inner = sum((held[i] % 4, held[i + 1] % 4) not in ((1, 2), (2, 3), (3, 2)) for i in range(len(held) - 1))
            return (part, seq, *now, bytes(held), np.array(chunk_costs(held), "<i8").tobytes(), inner)

        for b in batches:
            out = []
            for k, turn, role, tie, row, kind in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if now is None or k != now[0] or len(held) >= size:
                    if now is not None:
                        out.append(done())
                        seq += 1
                    now, held = (k, turn, role, tie, row), bytearray()
                held.append(kind)
            if out:
                yield _batch(out)
        if now is not None:
            yield _batch([done()])

    kind = "part long, seq long, k string, turn long, role string, tie long, row long, kinds binary, costs binary, illegal long"

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return _arrow(rows, kind)

    dealt = kinds.select("k", "turn", "role", "tie", "row", "kind")
    n = max(1, int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(dealt.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(pack, kind), "turn-chunks")


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(rows: list[tuple], kind: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in kind.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _by_conversation(table: DataFrame, columns: list[str], solve, kind: str) -> DataFrame:
    """``solve`` on the chunks of one conversation at a time, in order: lists of tuples that start with (k, part, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][0] != r[0]:
                    out += solve(held)
                    held = []
                held.append(r)
            if out:
                yield _arrow(out, kind)
        if held:
            yield _arrow(solve(held), kind)

    return table.select("k", "part", "seq", *columns).repartition("k").sortWithinPartitions("k", "part", "seq").mapInArrow(run, kind)


def _numbers(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<i8").tolist()


def _bounds(parts: list[tuple]) -> list[tuple]:
    """Costs from the start before each chunk and to the end after it, the whole cost, and whether it is the first and the last."""
    fronts, backs = [START], [END]
    for r in parts:
        fronts.append(through(fronts[-1], _numbers(r[3])))
    for r in reversed(parts):
        backs.append(through_back(backs[-1], _numbers(r[3])))
    backs.reverse()
    total = min(fronts[-1][q] for q in ENDS)
    pack = lambda x: np.array(x, "<i8").tobytes()
    return [(r[0], r[1], r[2], pack(fronts[i]), pack(backs[i + 1]), total, int(i == 0), int(i == len(parts) - 1)) for i, r in enumerate(parts)]


def _starts(parts: list[tuple]) -> list[tuple]:
    """The set of states before each chunk but the first, from the chunks' tables of sets."""
    out, at = [], parts[0][3][1]
    for r in parts[1:]:
        out.append((r[0], r[1], r[2], at))
        at = r[3][at]
    return out


def letters(packed: DataFrame) -> DataFrame:
    """``chunks`` with the letters of their edits, the whole cost of the conversation, and first, whether a chunk begins it."""
    bounds = _by_conversation(packed, ["costs"], _bounds, "k string, part long, seq long, before binary, after binary, total long, first long, last long")
    full = packed.join(bounds.drop("k"), ["part", "seq"])
    kind = "part long, seq long, letters string, sets binary"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part, seq, kinds, before, after, total, first, last, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = Walk(kinds, _numbers(before), _numbers(after), total)
                if first or start:
                    text, to = w.run(start or 1, bool(last))
                    out.append((part, seq, text, bytes([0, to])))
                else:  # the set before it is not known yet: where each of the 15 would lead
                    out.append((part, seq, None, bytes([0, *(w.run(s, False)[1] for s in range(1, 16))])))
            yield _arrow(out, kind)

    shape = ["part", "seq", "kinds", "before", "after", "total", "first", "last"]
    once = written(full.select(*shape, F.lit(0).cast("long").alias("start")).mapInArrow(walk, kind), "turn-walks")
    tables = packed.select("part", "seq", "k").join(once.select("part", "seq", "sets"), ["part", "seq"]).join(bounds.filter("first = 0 OR last = 0").select("part", "seq"), ["part", "seq"], "left_semi")
    starts = _by_conversation(tables, ["sets"], _starts, "k string, part long, seq long, start long").drop("k")
    rest = full.join(starts, ["part", "seq"]).select(*shape, "start").mapInArrow(walk, kind)
    found = once.filter("letters IS NOT NULL").unionByName(rest).select("part", "seq", "letters")
    return full.join(found, ["part", "seq"]).select("k", "turn", "role", "tie", "row", "letters", "total", "first")


def repaired(rows: DataFrame, edits: DataFrame, texts: bool = True) -> DataFrame:
    """The repaired conversations from ``faults`` rows and ``letters``.

    With ``texts`` one row a repaired turn (k, seq from 0, role, text), else one row a conversation (k, audit,
    cost, sha256 of its ``role:text`` lines).  A conversation streams through one task, as a
    digest has to; nothing but the audit is held.
    """
    nothing = lambda c, t: F.lit(None).cast(t).alias(c)
    lines = rows.select("k", "turn", "role", "tie", "row", F.lit(1).alias("tag"), "text", nothing("letters", "string"), nothing("total", "long"))
    marks = edits.select("k", "turn", "role", "tie", "row", F.lit(0).alias("tag"), nothing("text", "string"), "letters", "total")
    kind = "k string, seq long, role string, text string" if texts else "k string, audit string, cost long, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, at, state, seq, total, audit, digest = None, "", 0, 0, 0, 0, [], hashlib.sha256()
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal seq
            if texts:
                out.append((now, seq, role, text))
            else:
                digest.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
            seq += 1

        def added(role_text: str) -> None:
            nonlocal state
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            put(role, role_text)

        def ended() -> None:
            for _ in left[at:]:  # inserts after the last row
                added("")
            if not texts:
                out.append((now, "".join(audit), total, digest.hexdigest()))

        for b in batches:
            out = []
            for k, role, tag, text, some, cost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tag == 0:
                    if k != now:
                        if now is not None:
                            ended()
                        now, state, seq, total, audit, digest = k, 0, 0, cost, [], hashlib.sha256()
                    left, at = some, 0
                    if not texts:
                        audit.append(some)
                    continue
                while left[at] == "I":
                    added("")
                    at += 1
                letter, at = left[at], at + 1
                if letter == "K":
                    state = INITIALS.index(role[0])
                    put(role, text)
                elif letter == "R":
                    added(text)
            if out:
                yield _arrow(out, kind)
        out = []
        if now is not None:
            ended()
        if out:
            yield _arrow(out, kind)

    both = lines.unionByName(marks).repartition("k").sortWithinPartitions(*_ORDER, "tag")
    return both.select("k", "role", "tag", "text", "letters", "total").mapInArrow(run, kind)


def repair(rows: DataFrame, ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = CHUNK) -> DataFrame:
    """One row for every conversation of ``ids`` (its id column, repeats allowed): faults, cost, edits and digest.

    Columns: the id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    seen = faults(rows, conv, turn, role, text)
    kinds = written(judged(seen), "turn-kinds")
    packed = chunks(kinds, size)
    done = written(repaired(seen, letters(packed), texts=False), "repaired")
    of = lambda name: F.count_if(F.col("fault") == name).alias(name)
    counts = kinds.groupBy("k").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"), of("blank"), of("duplicate"), of("truncated"))
    inner = packed.groupBy("k").agg(F.sum("illegal").alias("illegal"), F.collect_list(F.struct("part", "seq", F.substring("kinds", 1, 1).alias("a"), F.substring("kinds", -1, 1).alias("b"))).alias("ends"))
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("int") % 4
    pairs = F.transform(F.array_sort("ends"), lambda e: F.struct(number(e["a"]).alias("a"), number(e["b"]).alias("b")))
    legal = lambda a, b: ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))
    joints = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda x, y: F.when(legal(x["b"], y["a"]), 0).otherwise(1))
    inner = inner.withColumn("p", pairs).select("k", (F.col("illegal") + F.aggregate(joints, F.lit(0), lambda n, x: n + x)).alias("illegal"))
    c = F.col(f"`{conv}`")
    every = ids.select(c.alias("id")).distinct().withColumn("k", F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("id").cast("string"))))
    out = every.join(counts, "k", "left").join(inner, "k", "left").join(done, "k", "left")
    zero = lambda x, name: F.coalesce(x, F.lit(0)).cast("long").alias(name)
    drop_written(seen)
    return out.select(
        F.col("id").alias(conv), zero(F.col("span") - F.col("turns"), "gaps"), *(zero(F.col(n), n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
