"""Removal of bytes that repeat an earlier 100-byte string, by collection suffix arrays.

The suffix order and common prefixes come from column-wise construction for many strings at once:
each round puts one more symbol of every string in front of its suffix, finds the suffix's place
through the Burrows-Wheeler transform built so far (its last-to-first mapping), inserts it, and
updates the common prefixes of the new suffix and its successor by range minima over the round
before.  As many rounds as the longest string has symbols; each reads the arrays once, in order.

Whole documents as strings would mean a pass over the collection for every byte of the longest
document.  So the collection is first cut down, without loss, to strings of at most 163 bytes:

1. Winnowing picks in every 100-byte string one of its 37-byte grams by hash, the same one
   wherever the string occurs.  A pick's surroundings are all the 100-byte strings it was picked
   in: 100 to 163 bytes, so that every string is looked at under one pick only.
2. Picks whose gram occurs once in the corpus are dropped.  Of equal surroundings the earliest
   stays, and the others are repeats as a whole.
3. Grams left with different surroundings are gathered gram by gram and refined: surroundings are
   cut into pieces of 100 to 101 bytes about a common core, pieces alone with their core go, and
   of equal pieces the earliest stays.
4. Pieces that differ about one core go through the construction above, which finds the 100-byte
   strings that some of them share.

Grams with more than ``most`` different surroundings are compared window by window, by grouped
minima, instead: that is the exact way for buckets that one task could not hold.

"Earlier" means a smaller id, then an earlier start.  Null ids come first; rows that repeat an id
are ordered by a number given once and stored.  Null and empty texts, and those under 100 bytes,
stay as they are; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import by_bytes, written

LENGTH = 100
#: Grams in the winnowing window, a power of two; a gram has LENGTH - WINDOW + 1 bytes.
WINDOW = 64
GRAM = LENGTH - WINDOW + 1
#: Bytes of documents looked at together, of strings refined together, of pieces in one construction.
BLOCK, BATCH, CONSTRUCT = 1 << 16, 2 << 20, 1 << 20
#: Blocks whose picks are returned together.
TOGETHER = 16
#: Windows in a piece; a power of two.
PIECE = 2
#: Different surroundings of one gram that go to one construction.
MOST = 50_000

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


class _Hasher:
    """Hashes of any substrings of a block from prefix sums, for two independent bases."""

    def __init__(self, size: int) -> None:
        self.size = 0
        self._grow(size)

    def _grow(self, size: int) -> None:
        self.size = size
        with np.errstate(over="ignore"):
            self.pow = [_powers(b, size + 1) for b in _BASES]
            self.inv = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), size + 1) for b in _BASES]

    def sums(self, raw: np.ndarray, k: int) -> np.ndarray:
        if len(raw) > self.size:
            self._grow(len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.pow[k][: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        return _mix((sums[b] - sums[a]) * self.inv[k][a] + (b - a).astype(np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """``pick`` over all windows of WINDOW entries."""
    w = 1
    while w < WINDOW:
        x = pick(x[:-w], x[w:])
        w *= 2
    return x


def _winnowed(texts: list[bytes], hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """The joined texts, where each ends, the grams' hashes, the least of every window (0: no window) and the places picked."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    none = np.zeros(0, np.uint64)
    if len(raw) < LENGTH:
        return raw, ends, none, none, np.zeros(0, np.int64)
    one = hasher.sums(raw, 0)
    n = len(raw) - GRAM + 1
    h = _mix((one[GRAM:] - one[:-GRAM]) * hasher.inv[0][:n])
    least = _slide(h, np.minimum)
    # a window counts where its LENGTH bytes lie in one text
    valid = np.zeros(len(least) + 1, np.int32)
    long = lens >= LENGTH
    np.add.at(valid, (ends - lens)[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    edge = np.zeros(WINDOW - 1, np.uint64)
    back = _slide(np.concatenate([edge, least, edge]), np.maximum)  # the largest minimum of the windows that hold a gram
    return raw, ends, h, np.concatenate([least, edge]), np.flatnonzero((back == h) & (h != 0))


def picks(texts: list[bytes], hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """(text number, where the surroundings begin, shape, gram hash, surroundings' hash) of every pick.

    The shape is the surroundings' length * WINDOW + the gram's place in them.
    """
    raw, ends, h, least, at = _winnowed(texts, hasher)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    text = np.searchsorted(ends, at, "right")
    # the windows a gram is the least of lie side by side: they are a run of equal minima, cut to the windows that hold it
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    stops = np.append(starts[1:], len(least))
    run, value = np.searchsorted(starts, at, "right") - 1, least[starts]
    while (other := value[run] != h[at]).any():
        run = run - other
    a = np.maximum(at + 1 - WINDOW, starts[run])
    b = np.minimum(at, stops[run] - 1) + LENGTH
    around = hasher.of(hasher.sums(raw, 1), a, b, 1) ^ _mix((at - a).astype(np.uint64) + np.uint64(7))
    begins = np.concatenate([[0], ends[:-1]])
    return text, a - begins[text], (b - a) * WINDOW + (at - a), h[at], around


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BLOCK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, int]]]:
    blocks = list(_blocks(texts))
    for k in range(0, len(blocks), TOGETHER):
        yield blocks[k : k + TOGETHER]


def find_picks(docs: DataFrame) -> DataFrame:
    """docs (id, tie, text) to id, tie, start, shape, h, around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(BLOCK + (1 << 18))
        for b in (part for whole in batches for part in by_bytes(whole, "text")):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            ids, ties = b.column("id").to_numpy(), b.column("tie").to_numpy()
            for several in _groups(texts):
                with np.errstate(over="ignore"):
                    found = [picks(texts[lo:hi], hasher) for lo, hi in several]
                text = np.concatenate([lo + f[0] for (lo, _), f in zip(several, found, strict=True)])
                start, shape, h, around = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
                yield pa.RecordBatch.from_pydict({"id": ids[text], "tie": ties[text], "start": start, "shape": shape.astype(np.int32), "h": h.view(np.int64), "around": around.view(np.int64)})

    return docs.mapInArrow(run, "id long, tie long, start long, shape int, h long, around long")


def often_picked(docs: DataFrame) -> DataFrame:
    """h of the grams that are picked twice or more; what a task sees is counted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(BLOCK + (1 << 18))
        for b in (part for whole in batches for part in by_bytes(whole, "text")):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            for several in _groups(texts):
                with np.errstate(over="ignore"):
                    found = [_winnowed(texts[lo:hi], hasher) for lo, hi in several]
                h, n = np.unique(np.concatenate([f[2][f[4]] for f in found]).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h, "n": n.astype(np.int64)})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


class _RangeMin:
    """Minima of ranges of an array, by blocks of 16 and a table over the blocks."""

    def __init__(self, x: np.ndarray) -> None:
        n = -(-len(x) // 16)
        self.x = np.full(n * 16, 255, np.uint8)
        self.x[: len(x)] = x
        self.table = [self.x.reshape(n, 16).min(1)]
        w = 1
        while 2 * w <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-w], last[w:]))
            w *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min of x[a..b], both ends included; most ranges are one entry."""
        out = self.x[a]
        wide = np.flatnonzero(b > a)
        if len(wide):
            out[wide] = self._wide(a[wide], b[wide])
        return out

    def _wide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.uint8)
        lane = np.arange(16)
        for s in range(0, len(a), 1 << 16):
            lo, hi = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            la, lb = lo >> 4, hi >> 4
            left = np.where((lane >= (lo & 15)[:, None]) & ((lane <= (hi & 15)[:, None]) | (la < lb)[:, None]), self.x.reshape(-1, 16)[la], 255).min(1)
            right = np.where(lane <= (hi & 15)[:, None], self.x.reshape(-1, 16)[lb], 255).min(1)
            m = np.where(la < lb, np.minimum(left, right), left)
            inner = lb - la > 1
            if inner.any():
                i, j = la[inner] + 1, lb[inner]
                level = np.frexp((j - i).astype(np.float64))[1] - 1
                for k in np.unique(level):
                    at = level == k
                    t = self.table[k]
                    sel = np.flatnonzero(inner)[at]
                    m[sel] = np.minimum(m[sel], np.minimum(t[i[at]], t[j[at] - (1 << int(k))]))
            out[s : s + (1 << 16)] = m
        return out


def collection_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) of all suffixes in order.

    Column-wise: round j inserts every string's suffix of length j.  Suffixes that are equal as a
    whole are ordered by string number (each string ends in a mark of its own); common prefixes
    are capped at 255.  Empty suffixes come first.
    """
    m = len(strings)
    lens = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lens)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    used, raw = np.unique(raw, return_inverse=True)  # symbols are numbered from 1; 0 stands before a string's first
    raw = (raw + 1).astype(np.uint8 if len(used) < 256 else np.uint16)
    alive = np.arange(m)
    place = np.arange(m)  # of each live string's newest suffix

    def before(who: np.ndarray, j: int) -> np.ndarray:
        if not len(raw):
            return np.zeros(len(who), raw.dtype)
        return np.where(lens[who] > j, raw[np.maximum(ends[who] - j - 1, 0)], 0).astype(raw.dtype)

    bwt = before(alive, 0)
    made, lcp = np.arange(m, dtype=np.int32), np.zeros(m, np.uint8)  # suffixes by number, in order of insertion
    rounds = [alive]
    upto, j = m, 0
    while True:
        live = lens[alive] > j
        alive, place = alive[live], place[live]
        if not len(alive):
            size = np.repeat(np.arange(len(rounds), dtype=np.int32), [len(x) for x in rounds])
            return np.concatenate(rounds).astype(np.int32)[made], size[made], lcp
        # last-to-first: the k-th of order stands at place m + k of the next arrays
        counts = np.bincount(bwt, minlength=len(used) + 1)
        order = np.argsort(bwt, kind="stable")[counts[0] :]
        c = bwt[place]
        by = np.lexsort((place, c))
        alive, place, c = alive[by], place[by], c[by]
        first = np.concatenate([[0], np.cumsum(counts[1:])])
        r = np.empty(len(place), np.int64)
        cuts = np.searchsorted(c, np.arange(len(used) + 2))
        for x in np.flatnonzero(cuts[1:] > cuts[:-1]):
            if x:
                r[cuts[x] : cuts[x + 1]] = first[x - 1] + np.searchsorted(order[first[x - 1] : first[x]], place[cuts[x] : cuts[x + 1]])
        low = _RangeMin(lcp)
        own, after = np.zeros(len(r), np.uint8), np.zeros(len(r), np.uint8)
        ok = r > first[c.astype(np.int64) - 1]
        own[ok] = np.minimum(low(order[r[ok] - 1] + 1, place[ok]), 254) + 1
        ok = r + 1 < first[c]
        after[ok] = np.minimum(low(place[ok] + 1, order[r[ok] + 1]), 254) + 1
        final = m + r
        total = m + len(order)
        is_old = np.ones(total, bool)
        is_old[final] = False
        stay = np.flatnonzero(is_old)
        j += 1

        def grown(old: np.ndarray, new: np.ndarray, stay=stay, final=final, total=total) -> np.ndarray:
            out = np.empty(total, old.dtype)
            out[stay] = old
            out[final] = new
            return out

        bwt, made, lcp = grown(bwt, before(alive, j)), grown(made, upto + np.arange(len(alive), dtype=np.int32)), grown(lcp, own)
        rounds.append(alive)
        upto += len(alive)
        follow = final + 1 < total
        at = final[follow] + 1
        old = is_old[at]
        lcp[at[old]] = after[follow][old]
        place = final


def shared_starts(strings: list[bytes], rank: np.ndarray, base: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of all starts whose ``length`` bytes also start earlier.

    String k stands in the document of order ``rank[k]`` from byte ``base[k]``.
    """
    string, size, lcp = collection_order(strings)
    lens = np.array([len(s) for s in strings], np.int64)
    ok = size >= length
    group = np.cumsum(lcp < length)[ok]
    string = string[ok].astype(np.int64)
    at = lens[string] - size[ok]
    if not len(group):
        return string, at
    where = rank[string] * np.int64(1 << 40) + base[string] + at
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(where, first)[np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))]
    late = where > least
    return string[late], at[late]


def _runs(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in a row, by key, as (key, first, last)."""
    if not len(key):
        return key, start, start
    o = np.lexsort((start, key))
    key, start = key[o], start[o]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], start[last]


def _strings(picked: DataFrame, docs: DataFrame) -> DataFrame:
    """The surroundings themselves: h, id, tie, base (where they begin), pick (the gram's place in them), body.

    A left join, as the last step's is, so that both read one exchange of the texts.
    """
    wanted = picked.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "shape", "h", "crowded")).alias("picks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole.filter(pc.is_valid(whole.column("start"))), "text")):
            bodies, picked_at = [], []
            lists = [b.column(c) for c in ("start", "shape", "h", "crowded")]
            owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists[0]).to_numpy())
            start, shape, h, crowded = (x.flatten() for x in lists)
            texts = b.column("text")
            now, raw = -1, b""
            for k, a, z in zip(owner.tolist(), start.to_pylist(), shape.to_pylist(), strict=True):
                if k != now:
                    now, raw = k, texts[k].as_py().encode()
                n, pick = divmod(z, WINDOW)
                bodies.append(raw[a : a + n])
                picked_at.append(pick)
            out = {"h": h, "id": b.column("id").take(pa.array(owner)), "tie": b.column("tie").take(pa.array(owner)), "base": start, "pick": pa.array(picked_at, pa.int64()), "body": pa.array(bodies, pa.binary()), "crowded": crowded}
            yield pa.RecordBatch.from_pydict(out)

    # one array a field, which Python holds as plain numbers
    rows = docs.join(wanted, ["id", "tie"], "left").select("id", "tie", "text", "picks.start", "picks.shape", "picks.h", "picks.crowded")
    return rows.mapInArrow(cut, "h long, id long, tie long, base long, pick long, body binary, crowded boolean")


def _refined(bodies: list[bytes], pick: np.ndarray, where: np.ndarray, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """What is left of the strings once cheap cases are decided.

    The starts around a pick fall into runs of ``PIECE``; all windows of a run hold the same 99
    bytes, its core.  Pieces (a run's windows of a string) whose core no other string has share
    nothing; of equal pieces the earliest stays and the others repeat as a whole.  Returns
    the pieces that repeat (string, first start, last start) and, to be constructed, groups of
    different pieces with one core, as rows of (string, first start, last start).
    """
    lens = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(lens) - lens
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    step, runs = PIECE, WINDOW // PIECE
    k = np.tile(np.arange(runs), len(bodies))
    string = np.repeat(np.arange(len(bodies)), runs)
    qa = np.maximum(pick[string] - WINDOW + 1 + step * k, 0)
    qb = np.minimum(pick[string] - WINDOW + step * (k + 1), lens[string] - LENGTH)
    some = qa <= qb
    string, k, qa, qb = string[some], k[some], qa[some], qb[some]
    core_a = begin[string] + pick[string] - WINDOW + step * (k + 1)
    core_b = begin[string] + pick[string] - WINDOW + 1 + step * k + LENGTH
    sums = [hasher.sums(raw, x) for x in (0, 1)]
    mixed = lambda a, b: hasher.of(sums[0], a, b, 0) ^ (hasher.of(sums[1], a, b, 1) << np.uint64(1))
    core = _mix(mixed(core_a, core_b) + k.astype(np.uint64))
    _, group, n = np.unique(core, return_inverse=True, return_counts=True)
    shared = n[group] > 1
    string, qa, qb, group = string[shared], qa[shared], qb[shared], group[shared]
    whole = mixed(begin[string] + qa, begin[string] + qb + LENGTH) + _mix((qa - pick[string] + WINDOW).astype(np.uint64))
    o = np.lexsort((where[string] + qa, whole, group))
    string, qa, qb, group, whole = string[o], qa[o], qb[o], group[o], whole[o]
    new = np.ones(len(o), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (group[1:] != group[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(o) else o
    late = ~new & (where[string] + qa > where[string[lead]] + qa[lead])
    copies = np.stack([string[late], qa[late], qb[late]])
    string, qa, qb, group = string[new], qa[new], qb[new], group[new]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    size = np.diff(np.append(first, len(group)))
    several = np.repeat(size > 1, size)
    rows = np.stack([string[several], qa[several], qb[several]])
    return copies[0], copies[1], copies[2], np.split(rows, np.cumsum(size[size > 1])[:-1], axis=1) if rows.size else []


def repeats_among(bodies: list[bytes], pick: np.ndarray, rank: np.ndarray, base: np.ndarray, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of the starts that repeat an earlier one; as runs of starts would be, but one by one."""
    where = rank * np.int64(1 << 40) + base
    with np.errstate(over="ignore"):
        s, qa, qb, groups = _refined(bodies, pick, where, hasher)
    n = qb - qa + 1
    out = [(np.repeat(s, n), np.repeat(qa, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
    pending: list[np.ndarray] = []
    held = 0
    for g in [*groups, None]:
        if g is not None:
            pending.append(g)
            held += int((g[2] - g[1]).sum()) + LENGTH * g.shape[1]
        if pending and (g is None or held >= CONSTRUCT):
            s, qa, qb = np.concatenate(pending, axis=1)
            pieces = [bodies[i][a : b + LENGTH] for i, a, b in zip(s.tolist(), qa.tolist(), qb.tolist(), strict=True)]
            k, at = shared_starts(pieces, rank[s], base[s] + qa)
            out.append((s[k], qa[k] + at))
            pending, held = [], 0
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _construct(strings: DataFrame) -> DataFrame:
    """id, tie, start, end: bytes of the strings that repeat earlier ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher(BATCH + (1 << 19))
        rows, held = [], 0

        def flush() -> pd.DataFrame:
            b = pd.concat(rows, ignore_index=True)
            docs = pd.MultiIndex.from_frame(b[["id", "tie"]])
            rank = pd.factorize(docs, sort=True)[0].astype(np.int64)
            base = b["base"].to_numpy(np.int64)
            k, at = repeats_among(b["body"].tolist(), b["pick"].to_numpy(np.int64), rank, base, hasher)
            k, first, last = _runs(k, base[k] + at)
            return pd.DataFrame({"id": b["id"].to_numpy()[k], "tie": b["tie"].to_numpy()[k], "start": first, "end": last + LENGTH})

        for b in batches:
            if held >= BATCH:
                same = (b["h"] == rows[-1]["h"].iloc[-1]).to_numpy()
                if not same.all():
                    cut = int(np.argmin(same))
                    rows.append(b.iloc[:cut])
                    yield flush()
                    rows, held, b = [], 0, b.iloc[cut:]
            rows.append(b)
            held += sum(map(len, b["body"]))
        if held:
            yield flush()

    return strings.repartition("h").sortWithinPartitions("h").mapInPandas(run, "id long, tie long, start long, end long")


def _by_windows(strings: DataFrame) -> DataFrame:
    """The same for crowded grams: every window goes to a grouped minimum by its digest."""
    places = F.explode(F.sequence(F.lit(0), F.octet_length("body") - LENGTH)).alias("k")
    rows = strings.filter(F.octet_length("body") >= LENGTH).select("id", "tie", "base", "body", places)
    rows = rows.select(F.sha2(F.expr(f"substring(body, k + 1, {LENGTH})"), 256).alias("d"), "id", "tie", (F.col("base") + F.col("k")).alias("start"))
    first = rows.groupBy("d").agg(F.min(F.struct("id", "tie", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = rows.join(first, "d").filter(F.struct("id", "tie", "start") > F.col("first"))
    return late.select("id", "tie", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs (id, tie, text) to id, tie, start, end: byte ranges that together are what to remove."""
    long = docs.filter(F.octet_length("text") >= LENGTH)
    often = written(often_picked(long), "often")  # so that the join's own exchange can split a gram that is everywhere
    again = written(find_picks(long).join(often, "h"), "picks")
    at = F.struct("id", "tie", "start")
    firsts = again.groupBy("h", "around").agg(F.min(at).alias("first"), F.min("shape").alias("shape"), F.count("*").alias("n"))
    firsts = written(firsts, "firsts")
    copies = firsts.filter("n > 1").select("h", "around", "first")
    whole = again.join(copies, ["h", "around"]).filter(at > F.col("first"))
    whole = whole.select("id", "tie", "start", (F.col("start") + F.expr(f"shape div {WINDOW}")).alias("end"))
    kinds = written(firsts.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    picked = firsts.join(kinds, "h").select("first.id", "first.tie", "first.start", "shape", "h", (F.col("kinds") > most).alias("crowded"))
    strings = _strings(picked, docs)
    if kinds.filter(F.col("kinds") > most).isEmpty():
        return whole.unionByName(_construct(strings))
    strings = written(strings, "strings")
    return whole.unionByName(_construct(strings.filter("NOT crowded"))).unionByName(_by_windows(strings.filter("crowded")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, spans (removed runs, [start, end) in bytes), kept; then the columns of ``carry``.

    ``kept`` is binary; with ``as_text`` it is a string, without characters that a cut has halved.
    """
    held = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(carry)]
    kinds = [(f"__{k}", dict(docs.dtypes)[c]) for k, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *held)
    repeats = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL")
    if repeats.isEmpty():
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    else:
        rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), "numbered")
    null_id = -(1 << 63)
    keyed = rows.withColumn("id", F.coalesce("id", F.lit(null_id)))
    spans = repeated_spans(keyed.select("id", "tie", "text"), most)
    gathered = spans.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, "text")):
            kept, sizes, removed, merged = [], [], [], []
            for text, start, end in zip(b.column("text"), b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                runs = _merged([(a, min(e, len(raw))) for a, e in zip(start, end, strict=True)] if start is not None else [])
                parts, upto = [], 0
                for a, e in runs:
                    parts.append(raw[upto:a])
                    upto = e
                parts.append(raw[upto:])
                sizes.append(len(raw))
                removed.append(sum(e - a for a, e in runs))
                merged.append([{"start": a, "end": e} for a, e in runs])
                kept.append("".join(p.decode(errors="ignore") for p in parts) if as_text else b"".join(parts))
            ids = b.column("id")
            out = [pc.if_else(pc.equal(ids, null_id), pa.scalar(None, pa.int64()), ids), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, span), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*out, *(b.column(c) for c, _ in kinds)], ["id", "n_bytes", "n_removed", "spans", "kept", *(c for c, _ in kinds)])

    out = keyed.join(gathered, ["id", "tie"], "left").select("id", "text", "spans.start", "spans.end", *(c for c, _ in kinds))
    schema = f"id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}"
    return out.mapInArrow(apply, schema + "".join(f", {c} {t}" for c, t in kinds)).toDF(id_col, "n_bytes", "n_removed", "spans", "kept", *carry)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs; those that touch are one."""
    runs: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        else:
            runs.append((a, e))
    return runs
