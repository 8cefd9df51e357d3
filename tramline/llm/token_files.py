"""Token ids as files: one concatenated array of ids, with the document boundaries in Elias-Fano code.

Texts are encoded by the tokenizers library, an end id is appended, and the ids, of two bytes where the
vocabulary allows, are laid out in ascending document id over range partitions, whose bounds come from the
ids alone so that a text is encoded once.  Each partition streams its ids into files that roll
at a weight of ids and documents; a file ends with two Elias-Fano sequences, the boundaries of its documents
and their ids, so that an offset needs a few bits and no table of 64-bit numbers.  Files are
written under temporary names and renamed; the manifest, a Parquet table with one row a file, is written last and
says at which id of the whole array a file begins.  What is not in the manifest is not in the archive.

A null text is an empty one and has only the end id.  Null document ids come last.  Rows with one id come
in the order of their texts' hash, equal rows side by side.  An empty table gives a manifest without rows.
Columns other than the id and the text are not read.  Document ids may span at most 63 bits a file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.shared import filesystem, json_literal, let, work_path, written

MAGIC = b"TOKIDS01"
#: Weight at which a file rolls: its ids, and so many for each document.
ROLL, DOC_WEIGHT = 64 << 20, 16
#: Set bits between two stored places of a select structure.
EVERY = 256
#: Words and runs whose ids a worker remembers in each of two generations, and bytes of ids or text that it hands on at once.
REMEMBERED, AT_ONCE = 400_000, 8 << 20
#: Letter runs that the library gets in one text.
JOINED = 500

#: Latin letters.  U+0130 isn't among them, as its lower case ends in a mark.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: A run of Latin letters before a stop, or all up to the next blank: no token spans two of them.
PIECES = re.compile(f"[{LETTERS}]+(?=[.,;:!?])|[^ \t-\r]+")
ALL_LETTERS = re.compile(f"[{LETTERS}]+")
#: The vocabulary's own split, and what bytes are to it: 0 blanks, 1 letters, 2 symbols, 3 digits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KIND = np.array([0 if i == 32 or 9 <= i <= 13 else 3 if 48 <= i <= 57 else 1 if i >= 128 or chr(i).isalpha() else 2 for i in range(256)], np.uint8)
#: Bytes that leave their word whole: controls, the apostrophe (the split looks ahead of it), what opens other letters than Latin ones.
ODD = np.array([i < 32 and KIND[i] > 0 or i in (39, 127) or 0xC0 <= i <= 0xC2 or i >= 0xCA for i in range(256)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class EliasFano:
    """A sorted sequence of numbers from 0: low bits packed, high bits as gaps in a bit vector with select samples.

    About 2 + log2(largest / n) bits a number.  ``get`` reads one number through the samples;
    ``slice`` decodes a run of them at once.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.unpackbits((v & np.uint64((1 << bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(place[-1]) + 1, np.uint8)
        marks[place] = 1
        return cls(n, bits, np.packbits(low.reshape(-1), bitorder="little"), np.packbits(marks, bitorder="little"), place[::EVERY].astype(np.uint32))

    def tobytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c, at + a + b))

    def _low(self, i: int, j: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(j - i, np.int64)
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first].reshape(j - i, self.low_bits)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def slice(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1."""
        if i >= j:
            return np.zeros(0, np.int64)
        start = int(self.samples[i // EVERY])  # the place of set bit i // EVERY * EVERY
        end = int(self.samples[(j - 1) // EVERY + 1]) if (j - 1) // EVERY + 1 < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :])[i % EVERY :][: j - i] + start
        return ((ones - np.arange(i, j)) << self.low_bits) | self._low(i, j)

    def get(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


class WordTokenizer:
    """A vocabulary file of the tokenizers library whose tokens never span blanks; the library sees each new piece once.

    What a Python worker has met is remembered for its next tasks, in two generations of bounded size.
    """

    _of_worker: dict[tuple, WordTokenizer] = {}

    def __init__(self, path: str, end: int) -> None:
        self.path, self.end = path, end
        self._library, self._young, self._old = None, {}, {}

    def __reduce__(self) -> tuple:
        return WordTokenizer._shared, (self.path, self.end)

    @classmethod
    def _shared(cls, path: str, end: int) -> WordTokenizer:
        return cls._of_worker.setdefault((path, end), cls(path, end))

    def _load(self) -> None:
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            vocabulary = self._library.get_vocab()
            self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self._closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            self.kind = "<u2" if max(self.end, *vocabulary.values()) < 1 << 16 else "<u4"
            own = json.loads(self._library.to_str())
            steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
            lowers = {"type": "Lowercase"} in (own["normalizer"] or {}).get("normalizers", [])
            self._runs = lowers and bool(steps) and steps[0].get("pattern") == {"Regex": SPLIT}
            self._added = [t["content"].encode().lower() for t in own["added_tokens"]]

    def width(self) -> int:
        self._load()
        return int(self.kind[-1])

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces by the library: letter runs many at a time, parted after the tokens that close a word."""
        out, plain, others = {}, [], []
        closes = self._closes.any()
        for p in pieces:
            (plain if closes and ALL_LETTERS.fullmatch(p) else others).append(p)
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            ids = np.array(self._library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self._closes[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                others += some
                continue
            raw, width = ids.tobytes(), ids.itemsize
            out.update((p, raw[width * x : width * y]) for p, x, y in zip(some, [0, *ends], ends, strict=False))
        for i in range(0, len(others), 10_000):
            some = others[i : i + 10_000]
            out.update((p, self._pack(e.ids)) for p, e in zip(some, self._library.encode_batch_fast(some, add_special_tokens=False), strict=True))
        return out

    def _new(self, words: list[str]) -> list[str]:
        """The words that are not remembered; those of the old generation move to the young one."""
        young, old, new = self._young, self._old, []
        for w in [w for w in words if w not in young]:
            raw = old.get(w)
            if raw is None:
                new.append(w)
            else:
                young[w] = raw
        return new

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of different words or runs; what is new goes to the library by its pieces."""
        new = self._new(words)
        parts = {w: PIECES.findall(w) for w in new if not w.isalpha()}  # letters alone are one piece
        pieces = [w for w in new if w not in parts]
        self._young.update(self._encoded(pieces + self._new(list({p for ps in parts.values() for p in ps}.difference(pieces)))))
        known = self._young.__getitem__
        self._young.update([(w, b"".join(map(known, ps))) for w, ps in parts.items()])
        out = list(map(known, words))
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, ``width`` bytes each."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.StringArray) -> pa.BinaryArray:
        """``encode`` of an Arrow column: runs are made numbers of different runs, whose ids are taken side by side."""
        self._load()
        runs, at = _runs(texts, self._added if self._runs else None)
        found = runs.dictionary_encode()
        ids = pa.array([*self._learn(found.dictionary.to_numpy(zero_copy_only=False).tolist()), self._pack([self.end])], pa.binary())
        flat = ids.take(pa.array(np.insert(found.indices.to_numpy(), at[1:], len(ids) - 1)))  # the end id after a text's runs
        _, offsets, raw = flat.buffers()
        ends = np.frombuffer(offsets, np.int32)[at + np.arange(len(at))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), raw])


def _runs(texts: pa.StringArray, added: list[bytes] | None) -> tuple[pa.StringArray, np.ndarray]:
    """The words between ASCII blanks of all texts, and at which of them each text begins and the last one ends.

    With ``added``, the tokens apart from the vocabulary, words of Latin letters, digits and ASCII symbols come in lower case
    and in the runs of ``SPLIT``, each encoded for itself; a word with an odd byte or an added token comes whole.
    """
    texts = texts.fill_null("")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    _, offsets, raw = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
    bounds -= bounds[0]
    kind = KIND[data]
    inside = kind > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    opens[heads] = inside[heads]
    words = np.flatnonzero(opens)
    if added is not None and len(words):
        odd, low = ODD[data], LOWER[data]
        x, y = data[:-1], data[1:]
        odd[1:] |= (x == 0xC3) & ((y == 0x97) | (y == 0xB7)) | (x == 0xC4) & (y == 0xB0) | (x == 0xC9) & (y >= 0x90)  # as LETTERS
        for token in added:
            odd[[m.start() for m in re.finditer(re.escape(token), low.data)]] = True
        plain = np.zeros(len(data), bool)
        plain[words[0] :] = np.repeat(~np.logical_or.reduceat(odd, words), np.diff(np.append(words, len(data))))
        opens[1:] |= plain[1:] & inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 3))
        data = np.where(plain, low, data)
        words = np.flatnonzero(opens)
    starts = np.append(np.flatnonzero(opens[inside]), np.count_nonzero(inside)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data[inside])])
    return runs, np.searchsorted(words, bounds)


def _place(id_col: str, text_col: str) -> Column:
    """Where a document lies: null ids last, rows of one id by a hash of their text."""
    doc = F.col(f"`{id_col}`").cast("long")
    return F.struct(doc.isNull().alias("none"), F.coalesce(doc, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tie"))


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, int]:
    """A document's range, of as many as shuffles have parts: found on the narrow places, so that texts are encoded once."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    places = docs.select(_place(id_col, text_col).alias("place")).repartitionByRange(n, "place")
    firsts = places.groupBy(F.spark_partition_id().alias("part")).agg(F.min("place").alias("place")).orderBy("place").collect()
    cuts = [r.place.asDict() for r in firsts[1:]]
    at = json_literal(cuts, "array<struct<none:boolean,id:bigint,tie:bigint>>")
    steps = F.array(*(F.lit(1 << s) for s in range(max(1, len(cuts).bit_length()) - 1, -1, -1)))
    search = lambda key: F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= len(cuts)) & (F.get(at, low + s - 1) <= key), low + s).otherwise(low))
    return let(_place(id_col, text_col), search), len(cuts) + 1


def encode(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text", part: Column | None = None) -> DataFrame:
    """(doc_id, part, tie, ids): ``tokenizer.width()`` bytes an id, the end id last; ``part`` and the text's hash are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0)
            at = 0
            for j in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1).tolist(), len(texts)]:
                if j > at:
                    ids = tokenizer.encode_column(texts.slice(at, j - at))
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, j - at) for i in range(3)), ids], ["doc_id", "part", "tie", "ids"])
                at = j

    part = F.lit(0) if part is None else part
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), part.cast("int").alias("part"), _place(id_col, text_col)["tie"].alias("tie"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, tie long, ids binary")


def write_files(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL) -> str:
    """Write the texts' ids as files in the shared folder, in ascending document id; returns the folder."""
    folder = work_path(docs.sparkSession, "tokens")
    part, n = _ranges(docs, id_col, text_col)
    width = tokenizer.width()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        out, seq, held = None, 0, {"part": None}

        def close() -> pa.RecordBatch:
            ids, docs_, at = np.array(held["ids"], np.int64), len(held["ends"]), held["at"]
            base = int(ids[0]) if len(ids) else 0
            boundaries = EliasFano.encode(np.array(held["ends"], np.int64)).tobytes()
            names = EliasFano.encode((ids - base).view(np.uint64)).tobytes()
            foot = json.dumps({"ids": at, "width": width, "docs": docs_, "nulls": held["nulls"], "base": base, "boundaries": len(boundaries), "names": len(names)}).encode()
            out.write(boundaries + names + foot + struct.pack("<I", len(foot)) + MAGIC)
            out.close()
            name = f"part-{held['part']:06d}-{seq:06d}.ids"
            system.move(held["temp"], f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([held["part"]], pa.int32()), "seq": [seq], "name": [name], "n_ids": [at], "n_docs": [docs_]})

        for b in batches:
            for doc, part, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if out is not None and (part != held["part"] or held["at"] + DOC_WEIGHT * len(held["ends"]) >= roll):
                    yield close()
                    out, seq = None, seq + 1 if part == held["part"] else 0
                if out is None:
                    held = {"part": part, "ends": [], "ids": [], "nulls": 0, "at": 0, "temp": f"{path}/.part-{part}-{os.urandom(8).hex()}"}
                    out = system.open_output_stream(held["temp"], compression=None)
                    out.write(MAGIC)
                raw = ids.as_buffer()
                out.write(raw)
                held["at"] += raw.size // width
                held["ends"].append(held["at"])
                if doc is None:
                    held["nulls"] += 1
                else:
                    held["ids"].append(doc)
        if out is not None:
            yield close()

    rows = encode(docs, tokenizer, id_col, text_col, part).repartitionById(n, F.col("part"))
    dealt = rows.sortWithinPartitions("part", F.asc_nulls_last("doc_id"), "tie").select("doc_id", "part", "ids")
    files = written(dealt.mapInArrow(write, "part int, seq long, name string, n_ids long, n_docs long"), "token-parts")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


class TokenFile:
    """One file: its documents by number, through the select structures; ids are read where they lie."""

    def __init__(self, system, path: str) -> None:
        self.source = system.open_input_file(path)
        size = self.source.size()
        (n,) = struct.unpack("<I", self.source.read_at(4, size - 12))
        if self.source.read_at(8, size - 8) != MAGIC or self.source.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a whole file of token ids")
        self.foot = json.loads(self.source.read_at(n, size - 12 - n))
        self.width = self.foot["width"]
        a, b = self.foot["boundaries"], self.foot["names"]
        self.ends = EliasFano.frombytes(self.source.read_at(a, size - 12 - n - b - a))
        self.names = EliasFano.frombytes(self.source.read_at(b, size - 12 - n - b))

    def __len__(self) -> int:
        return self.foot["docs"]

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 begin, and where the last of them ends."""
        return np.concatenate([[0], self.ends.slice(0, j)]) if i == 0 else self.ends.slice(i - 1, j)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        known = len(self) - self.foot["nulls"]
        some = self.names.slice(i, min(j, known)) + self.foot["base"]
        return [*some.tolist(), *[None] * (j - max(i, known) if j > known else 0)]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from one place of the array to another, as little-endian numbers of four bytes."""
        raw = self.source.read_at(self.width * (end - start), len(MAGIC) + self.width * start)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4", copy=False)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, i + 1).tolist()
        return self.ids(a, b)


def read_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and the ids as an array if asked for, one row a document."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    files = spark.read.parquet(f"{folder}/manifest").select("name", "start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(folder)
        for b in batches:
            for name, base in zip(b["name"], b["start"], strict=True):
                f = TokenFile(system, f"{path}/{name}")
                i, n = 0, len(f)
                while i < n:
                    at = f.bounds(i, min(n, i + 10_000))
                    j = i + max(1, int(np.searchsorted(at, at[0] + AT_ONCE // 4, "right")) - 1)  # documents up to so many bytes, or one longer
                    at = at[: j - i + 1]
                    own = f.ids(int(at[0]), int(at[-1]))
                    cut = (at - at[0]).tolist()
                    each = [own[x:y] for x, y in zip(cut, cut[1:], strict=False)]
                    out = {"doc_id": pd.array(f.doc_ids(i, j), "Int64"), "start": at[:-1] + base, "n_tokens": np.diff(at), "ids_crc32": [zlib.crc32(x) for x in each]}
                    if ids:
                        out["ids"] = [x.astype(np.int64) for x in each]
                    yield pd.DataFrame(out)
                    i = j

    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(read, schema)
