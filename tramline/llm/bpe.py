"""Byte-level BPE over a corpus: distinct pre-tokens are encoded once, globally.

Documents are cut into pre-tokens once.  Every document becomes its pre-tokens' numbers by position,
and a chunk of documents, some megabytes of them, names each of its distinct pre-tokens once; both
are written to the shared folder.  The names are exploded to (chunk, number, word) and shuffled by
word, so that every word of the corpus is encoded once; its ids go back to the chunks by number,
where the documents, read from the written file, get their ids gathered by position.  What is shuffled by word is a chunk's vocabulary,
and a word has at most one row a chunk, so no word's rows grow faster than the chunks; they are
streamed, never gathered.  Decoding joins ids with the token-byte table, whose size is the
vocabulary file's (50,256 rows), in the tasks.

A null text is an empty one and has no ids.  Repeated and equal rows are encoded alike; an empty
table gives an empty one.  Columns other than the id and the text are not read.  A chunk whose
words did not all come back is an error, never a guess.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyarrow import compute as pc
from pyarrow import parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import filesystem, written

#: Characters of documents in one chunk, and chunks that a partition may have.
CHUNK_CHARS, CHUNKS = 32 << 20, 1 << 24
#: Documents returned at once.
AT_ONCE = 500

#: The letters, numbers and blanks below U+0250; U+2010 to U+205E has none but for what ``OTHER`` finds.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = " \t-\r\x85\xa0"
OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")


def plain_pattern(pattern: str) -> str | None:
    """The pattern with its classes written out, the same for texts without ``OTHER``; None if it has other escapes."""
    classes = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": SPACES}
    out = []
    for k, part in enumerate(re.split(r"(\[[^\]]*\])", pattern)):
        for name, body in classes.items():
            part = part.replace(name, body if k % 2 else f"[{body}]")
        out.append(part if k % 2 else part.replace(r"\S", f"[^{SPACES}]"))
    plain = "".join(out)
    return None if "\\" in plain else plain


class Vocabulary:
    """The ranks of a vocabulary file and the pattern that goes with it; both are parameters."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.kind = "<u2" if max(self.ranks.values(), default=0) < 1 << 16 else "<u4"
        self._find = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "ranks": self.ranks, "kind": self.kind, "_find": None}

    def words(self, text: str | None) -> list[str]:
        """The pre-tokens of a text; those of mostly Latin letters are found by a plainer, faster pattern."""
        if self._find is None:
            plain = plain_pattern(self.pattern)
            self._find = regex.compile(self.pattern).findall, re.compile(plain).findall if plain else None
        every, plain = self._find
        if not text:
            return []
        return plain(text) if plain and OTHER.search(text) is None else every(text)

    def encode_word(self, word: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until none is left."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 200:
            return self._encode_long(parts)
        rank, none = self.ranks.get, 1 << 60
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _encode_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap, n log n, for very long words."""
        import heapq

        n, rank = len(parts), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n and (r := rank(parts[k] + parts[m])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return [self.ranks[p] for p, ok in zip(parts, alive, strict=True) if ok]

    def token_bytes(self) -> list[bytes]:
        table = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            table[i] = token
        return table


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, which compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices [start, start + size) of ``flat``, one after the other."""
    return flat[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def cut(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows (id, text) to chunk, id, seq (the numbers of a document's pre-tokens, by position) and, one row a chunk, words and their numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, chunk = sent.value, TaskContext.get().partitionId() * CHUNKS
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        held, some = 0, False

        def names() -> pd.DataFrame:
            words = sorted(number)  # neighbours look alike, which spares bytes
            return pd.DataFrame({"chunk": [chunk], "id": [None], "seq": [None], "words": [words], "nos": [[number[w] for w in words]]})

        for b in batches:
            for a in range(0, len(b), AT_ONCE):
                part, seqs, chunks = b.iloc[a : a + AT_ONCE], [], []
                for t in part["text"]:
                    if held and held + len(t or "") > CHUNK_CHARS:
                        yield names()
                        number.clear()
                        chunk, held = chunk + 1, 0
                    seqs.append(_packed(np.fromiter(map(number.__getitem__, v.words(t)), np.int64)))
                    chunks.append(chunk)
                    held += len(t or "")
                yield pd.DataFrame({"chunk": chunks, "id": part["id"], "seq": seqs, "words": None, "nos": None})
                some = True
        if some:
            yield names()

    return rows.mapInPandas(run, "chunk long, id string, seq binary, words array<string>, nos array<int>")


def encoded_words(names: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """names (chunk, no, word) to chunk, nos, sizes, ids: every distinct word encoded once, its ids for each chunk that has it.

    A row holds what one Arrow batch has for a chunk.
    """
    sent = names.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, last, known = sent.value, None, []
        for b in batches:
            if not len(b):
                continue
            word, chunk, no = b["word"].to_numpy(object), b["chunk"].to_numpy(np.int64), b["no"].to_numpy(np.int64)
            new = np.concatenate([[True], word[1:] != word[:-1]])
            coded = [known if w == last else v.encode_word(w.encode()) for w in word[new]]
            last, known = word[-1], coded[-1]
            length = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((i for ids in coded for i in ids), v.kind, int(length.sum()))
            run_of = np.cumsum(new) - 1
            order = np.argsort(chunk, kind="stable")
            size = length[run_of][order]
            ids = _gathered(flat, (np.cumsum(length) - length)[run_of][order], size)
            chunk, no, upto = chunk[order], no[order], np.concatenate([[0], np.cumsum(size)])
            edge = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]])
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            yield pd.DataFrame({"chunk": chunk[edge[:-1]], "nos": [_packed(no[a:z]) for a, z in spans], "sizes": [_packed(size[a:z]) for a, z in spans], "ids": [ids[upto[a] : upto[z]].tobytes() for a, z in spans]})

    return names.repartition("word").sortWithinPartitions("word").mapInPandas(run, "chunk long, nos binary, sizes binary, ids binary")


class _Words:
    """The ids of a chunk's words, by number."""

    def __init__(self, parts: list[tuple[bytes, bytes, bytes]], kind: str) -> None:
        none = [np.zeros(0, np.uint32)]
        no = np.concatenate(none + [_unpacked(n) for n, _, _ in parts]).astype(np.int64)
        length = np.concatenate(none + [_unpacked(z) for _, z, _ in parts]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(ids for _, _, ids in parts), kind)
        self.size, self.start = np.full(len(no), -1, np.int64), np.zeros(len(no), np.int64)
        if len(no) and no.max() >= len(no):
            raise ValueError("words of a chunk did not come back")
        self.size[no], self.start[no] = length, np.cumsum(length) - length
        if (self.size < 0).any():
            raise ValueError("words of a chunk did not come back")

    def ids(self, seq: bytes) -> np.ndarray:
        no = _unpacked(seq)
        if len(no) and int(no.max()) >= len(self.size):
            raise ValueError("words of a chunk did not come back")
        return _gathered(self.flat, self.start[no], self.size[no])


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """id, ids (array<int>): the token ids of every text.

    ``with_bytes`` decodes each row's ids in the same task, as ``decode`` would later.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # as text, so that nulls make no floats of ids
    done = written(cut(rows, vocabulary), "bpe-cut", compression="zstd")
    heads = done.filter("words IS NOT NULL")
    names = heads.select("chunk", F.explode(F.arrays_zip("nos", "words")).alias("w")).select("chunk", F.col("w.nos").alias("no"), F.col("w.words").alias("word"))
    nothing = F.lit(None).cast("binary")
    table = encoded_words(names, vocabulary).withColumn("path", F.lit(None).cast("string"))
    asked = heads.select("chunk", nothing.alias("nos"), nothing.alias("sizes"), nothing.alias("ids"), F.col("_metadata.file_path").alias("path"))
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = sent.value
        tokens = TokenBytes(v) if with_bytes else None

        def documents(chunk: int, path: str, parts: list) -> Iterator[pd.DataFrame]:
            words = _Words(parts, v.kind)
            for ids, seqs in _chunk_documents(path, chunk):
                own = [words.ids(x).astype(np.int32) for x in seqs]
                yield pd.DataFrame({"id": ids, "ids": own} | ({"bytes": [tokens.joined(x) for x in own]} if tokens else {}))

        now, at, parts = None, None, []
        for b in batches:
            for chunk, nos, sizes, ids, path in zip(b["chunk"], b["nos"], b["sizes"], b["ids"], b["path"], strict=True):
                if chunk != now and now is not None:
                    yield from documents(now, at, parts)
                    parts = []
                now = chunk
                if path is None:
                    parts.append((nos, sizes, ids))
                else:
                    at = path
        if now is not None:
            yield from documents(now, at, parts)

    schema = "id string, ids array<int>" + ", bytes binary" * with_bytes
    both = table.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk")
    out = both.mapInPandas(assemble, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), "ids", *["bytes"] * with_bytes)


def _chunk_documents(path: str, chunk: int) -> Iterator[tuple[list, list]]:
    """(ids, seqs) of a chunk's documents, some at a time, from the written file that holds them."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        groups = [g for g in range(file.num_row_groups) if (k := file.metadata.row_group(g).column(0).statistics) is None or not k.has_min_max or k.min <= chunk <= k.max]
        for part in file.iter_batches(AT_ONCE, row_groups=groups, columns=["chunk", "id", "seq"]):
            own = part.filter((pc.field("chunk") == chunk) & pc.field("seq").is_valid())
            if own.num_rows:
                yield own["id"].to_pylist(), own["seq"].to_pylist()


class TokenBytes:
    """The token-byte table, laid end to end; joining many ids with it is one gather."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        table = vocabulary.token_bytes()
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        return _gathered(self.flat, self.start[ids], self.size[ids]).tobytes()


def decode(coded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``bytes`` (binary): each row's ids joined with the token-byte table."""
    sent = coded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(coded.dtypes)[id_col]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = TokenBytes(sent.value)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": b["ids"], "bytes": [table.joined(np.asarray(x, np.int64)) for x in b["ids"]]})

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(join, f"id {kind}, ids array<int>, bytes binary").toDF(id_col, "ids", "bytes")
