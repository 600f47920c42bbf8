"""Packing into fixed windows by lexical retrieval.

Documents are encoded once; whole windows of a long one stand alone. What is left of
each goes to a BM25 index, weighed by token frequencies over all documents. The index
is sharded over the whole corpus: rests are range-sorted by the least hashes of the
terms that they would ask for, so that a shard, a bounded run of them, holds those that
ask for the same. In a shard each seed document gets all unused neighbours, best first,
which greedily fill its window; the last one is cut to fit. Only then unrelated ones
follow. What is left at the end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, text_of, tidied

VOCABULARY, END, WINDOW = "word_bpe_49k.json", 1, 2048
#: A shard ends with the document that brings it to either of these.
SHARD_DOCS, SHARD_TOKENS = 4096, 1_500_000
#: BM25, and the terms asked of a seed: those of the highest weight.
K1, B, TERMS = 1.2, 0.75, 12
#: Neighbours that are sorted first; the others only if these do not fill the window.
FIRST = 128
#: Words whose ids a worker remembers: so many new ones, and as many from before them.
REMEMBERED = 800_000
#: Bytes of text encoded at a time.
TOGETHER = 8 << 20


class Encoder:
    """Ids of texts by the library ``tokenizers``, remembered by word.

    White space ends a word for this tokenizer, so a text's ids are those of its
    words in turn. So does an ASCII letter before ASCII punctuation at a word's end, and
    it lowers case: a text is first set in lower case, with a space before such marks.
    New words are encoded together and cut apart by the places of their tokens. Texts
    that may hold a special token are encoded as they stand.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.size = self.t.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def alone(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def known(self, w: bytes) -> bytes | None:
        """Ids of a word met before; one from the older generation joins the younger."""
        raw = self.young.get(w)
        if raw is None and (raw := self.old.get(w)) is not None:
            self.young[w] = raw
        return raw

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [x for x in texts if len(x) < 1000 and (x.isascii() or is_normalized("NFC", x))]
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            whole = self.t.encode(" ".join(part), add_special_tokens=False)
            first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
            at = np.searchsorted([a for a, _ in whole.offsets], first).tolist()
            raw, n = np.array(whole.ids, dtype=self.kind).tobytes(), self.kind.itemsize
            self.young.update((x.encode(), raw[a * n : b * n]) for x, a, b in zip(part, at, at[1:], strict=False))
        self.young.update((x.encode(), self.alone(x)) for x in set(texts).difference(plain))

    def encode_batch(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Ids as little-endian bytes, with the id ``end`` after each text. A word is looked up once a batch."""
        special = pc.match_substring(texts, "<|")
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-/:-@\[-`{-~]+)([\x20\x09-\x0D]|\z)", r"\1 \2\3")
        # ASCII white space only: less than the tokenizer's own, which is safe.
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", apart))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        raws = list(map(self.young.get, words))
        gone = [i for i, raw in enumerate(raws) if raw is None]
        self.learn([words[i] for i in gone if self.known(words[i]) is None])
        for i in gone:
            raws[i] = self.young[words[i]]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {b"": b""}
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // self.kind.itemsize
        start = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        take = size[codes]
        past = np.concatenate([[0], np.cumsum(take)])
        ids = np.frombuffer(b"".join(raws), self.kind)[np.repeat(start[codes] - past[:-1], take) + np.arange(past[-1])]
        ends = past[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if end is not None:
            ids = np.insert(ids, ends[1:], end)
            ends = ends + np.arange(len(ends))
        at = pa.array((ends * self.kind.itemsize).astype(np.int32))
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, at.buffers()[1], pa.py_buffer(ids.tobytes())])
        if pc.any(special).as_py():
            last = b"" if end is None else np.array([end], dtype=self.kind).tobytes()
            whole = [self.alone(x) + last if odd else b"" for x, odd in zip(texts.to_pylist(), special.to_pylist(), strict=True)]
            out = pc.if_else(special, pa.array(whole, pa.binary()), out)
        return out


def together(parts: Iterator[pa.RecordBatch], least: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``least`` bytes, as a word is looked up once in each."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(x.nbytes for x in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encoded(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id and ids (bytes, ``end`` last) of each document; null text is empty."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(parts):
            yield pa.RecordBatch.from_arrays([part.column(0), encoder(vocabulary).encode_batch(part.column(1), end)], names=["doc_id", "ids"])

    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def document_frequency(rows: DataFrame, kind: str, size: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each id, number of documents, tokens; over all rows. Its size is the vocabulary's."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = np.zeros(size + 1, np.int64), 0, 0
        for part in parts:
            for raw in part.column(0).to_pylist():
                ids = np.frombuffer(raw, dtype=kind)
                held[np.unique(ids, return_counts=True)[0]] += 1  # sorts, which is quicker here than hashing
                docs, total = docs + 1, total + len(ids)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [docs, total]))], names=["id", "n"])

    sums = {r.id: r.n for r in rows.select("ids").mapInArrow(batches, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    held = np.zeros(size + 1)
    for i, n in sums.items():
        if i >= 0:
            held[i] = n
    return held, sums.get(-1, 0), sums.get(-2, 0)


def asked(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Places of the terms that a document asks for: the TERMS of the highest weight, first places first of equal ones."""
    return np.argsort(-weights, kind="stable")[:TERMS]


def bm25(idf: np.ndarray, tf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def signature(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[int, int]:
    """The two least hashes of the terms that a document asks for: alike for documents that ask for the same."""
    terms, tf = np.unique(ids, return_counts=True)
    own = terms[asked(terms, bm25(idf[terms], tf, len(ids), mean))]
    least = np.sort(own.astype(np.uint32) * np.uint32(2654435761))
    return int(least[0]), int(least[min(1, len(least) - 1)])


class Shard:
    """BM25 index over the rests of a run of documents, and the windows made of them."""

    def __init__(self, idf: np.ndarray, mean: float, window: int):
        self.idf, self.mean, self.window = idf, mean, window

    def index(self, pieces: list[np.ndarray]) -> None:
        size = len(self.idf)
        self.length = np.array([len(p) for p in pieces], np.int64)
        kind = np.int32 if len(pieces) * size < 1 << 31 else np.int64
        keys, tf = np.unique(np.concatenate([p.astype(kind) + i * size for i, p in enumerate(pieces)]), return_counts=True)
        doc, self.term = keys // size, keys % size
        self.weight = bm25(self.idf[self.term], tf, self.length[doc], self.mean)
        self.of_doc = np.searchsorted(doc, np.arange(len(pieces) + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = doc[by_term], self.weight[by_term]
        self.terms, of_term = np.unique(self.term[by_term], return_index=True)
        self.of_term = np.append(of_term, len(by_term))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each document for the terms that ``seed`` asks for."""
        own = slice(self.of_doc[seed], self.of_doc[seed + 1])
        score = np.zeros(len(self.length))
        for t in np.searchsorted(self.terms, self.term[own][asked(self.term[own], self.weight[own])]):
            s = slice(self.of_term[t], self.of_term[t + 1])
            score[self.post_doc[s]] += self.post_weight[s]
        return score

    def order(self, pieces: list[np.ndarray]) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of (piece, start, length); each id of each piece is in one of them once.

        The longest unused piece is the seed. Its neighbours that fit are taken whole, best
        first; then the best one left is cut, and after all neighbours the longest piece left.
        """
        self.index(pieces)
        n, length = len(pieces), self.length
        start, used = np.zeros(n, np.int64), np.zeros(n, bool)
        longest, at = np.lexsort((np.arange(n), -length)), 0
        while True:
            while at < n and used[longest[at]]:
                at += 1
            if at == n:
                return
            seed = int(longest[at])
            out, gap = [(seed, int(start[seed]), int(length[seed]))], self.window - int(length[seed])
            used[seed] = True
            if gap:
                score = self.scores(seed)
                score[used] = 0
                found = np.flatnonzero(score)
                rest: list[int] = []  # neighbours that did not fit, best first
                if len(found) > FIRST:
                    top = np.argpartition(-score[found], FIRST)
                    blocks = [found[top[:FIRST]], found[top[FIRST:]]]
                else:
                    blocks = [found]
                for block in blocks:
                    if not gap:
                        break
                    for d in block[np.lexsort((block, -score[block]))].tolist():
                        if length[d] <= gap:
                            out.append((d, int(start[d]), int(length[d])))
                            used[d] = True
                            gap -= int(length[d])
                            if not gap:
                                break
                        else:
                            rest.append(d)
                spare, cut = at, iter(rest)
                while gap:
                    d = next(cut, -1)
                    if d < 0:
                        while spare < n and used[longest[spare]]:
                            spare += 1
                        if spare == n:
                            break
                        d = int(longest[spare])
                    take = min(gap, int(length[d]))
                    out.append((d, int(start[d]), take))
                    start[d] += take
                    length[d] -= take
                    gap -= take
                    used[d] = not length[d]
            yield out


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Rows:
    """Output rows of one task, given out as record batches."""

    def __init__(self, doc_type: pa.DataType):
        self.names = ["doc_id", *(c.split()[0] for c in PIECE.split(", "))]
        self.kinds = [doc_type] + [pa.int64()] * 6 + [pa.binary()]
        self.made: list[tuple] = []

    def put(self, doc, start: int, part: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.made.append((doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, sequence, offset, part.tobytes()))

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.made) >= least:
            columns = zip(*self.made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)], names=self.names)
            self.made.clear()


@tidied
def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (bytes).

    A null or empty text is the id ``end`` alone; rows that repeat an id are
    documents of their own. An empty table gives no rows. Sequence ids are unique
    over all partitions; a task that runs again gives the same ones.
    """
    enc = encoder(vocabulary)
    size, kind, width = enc.size, enc.kind.str, enc.kind.itemsize
    rows = staged(encoded(docs, text, key, vocabulary, end), "encoded")
    held, count, total = document_frequency(rows, kind, size)
    idf = np.log1p((count - held + 0.5) / (held + 0.5)).astype(np.float32)
    mean = max(1.0, total / max(1, count))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # The whole windows of a document, and its rest, are cut on the JVM side.
    tokens = (F.octet_length("ids") / width).cast("long")
    cut = rows.withColumn("total", tokens).withColumn("whole", F.expr(f"total div {window} * {window}"))
    bytes_ = lambda a, n: F.substring("ids", (a * width).cast("int") + 1, (n * width).cast("int"))
    heads = cut.filter("whole > 0").select("doc_id", "total", bytes_(F.lit(0), F.col("whole")).alias("ids"))
    rests = cut.filter("whole < total").select("doc_id", "total", "whole", bytes_(F.col("whole"), F.col("total") - F.col("whole")).alias("ids"))

    def whole_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33  # even ones
        for part in parts:
            out = Rows(part.column(0).type)
            for doc, n, raw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(raw, dtype=kind)
                for i in range(0, len(own), window):
                    out.put(doc, i, own[i : i + window], n, sequence, 0)
                    sequence += 2
            yield from out.flush()

    def signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = [signature(np.frombuffer(raw, dtype=kind), idf, mean) for raw in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1))], names=["doc_id", "total", "whole", "ids", "m", "n"])

    def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId() << 33) + 1  # odd ones
        held: list[tuple] = []  # doc_id, total, whole, ids of this shard
        weight, out = 0, None

        def close() -> None:
            nonlocal sequence
            for group in Shard(idf, mean, window).order([x[3] for x in held]) if held else ():
                filled = sum(n for _, _, n in group)
                room = [window] if filled == window else powers(filled)
                offset = 0
                for d, start, n in group:
                    doc, total, whole, ids = held[d]
                    while n:
                        take = min(n, room[0] - offset)
                        out.put(doc, whole + start, ids[start : start + take], total, sequence, offset)
                        start, n, offset = start + take, n - take, offset + take
                        if offset == room[0]:
                            room.pop(0)
                            sequence, offset = sequence + 2, 0
            held.clear()

        for part in parts:
            out = out or Rows(part.column(0).type)
            for doc, n, whole, raw in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                held.append((doc, n, whole, np.frombuffer(raw, dtype=kind)))
                weight += len(held[-1][3])
                if len(held) >= shard_docs or weight >= shard_tokens:
                    close()
                    weight = 0
                    yield from out.flush(4096)
        close()
        if out:
            yield from out.flush()

    schema = f"doc_id {id_type}, {PIECE}"
    marked = staged(rests.mapInArrow(signed, f"doc_id {id_type}, total long, whole long, ids binary, m long, n long"), "rests")
    # Rows of one signature, be they a third of all, are told apart by a hash.
    line = [F.col("m"), F.col("n"), F.xxhash64("ids", "doc_id")]
    ordered = marked.repartitionByRange(*line).sortWithinPartitions(*line, "doc_id").drop("m", "n")
    return heads.mapInArrow(whole_windows, schema).unionByName(ordered.mapInArrow(shards, schema))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")


SQL: dict[str, str] = {}  # a tokenizer and a search; tests check an exact round trip
QUERIES = {"op9_packing": op9_packing}
