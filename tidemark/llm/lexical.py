"""Ranked lexical search: an inverted index scored window by window.

A scan cuts the corpus into windows of at most `WINDOW` documents, numbered in the window by ascending
doc_id (a window is of documents, not of id values, as ids may lie far apart or repeat), and writes a row for each term of a window: the numbers of the documents that hold it and
how often. The table is sorted by term, so a search reads the parts that its own terms lie in; a term
that every document has is a row per window and lies in as many files as it needs.

A search takes the postings of its terms to the tasks by window and traverses them there. For each item
the scores of a window are scattered into one array as long as the window (32 KB), the documents
reached are kept as a bitset, and what stands at its set bits is harvested into the item's heap of the
best k. A heap lives as long as its task, so its least score lets later windows pass by unseen documents
early. A task returns k rows an item; ranks come from those. Only totals, and how many documents hold
each term searched for, are known to the driver.

Items go to the tasks in parts of at most `ITEM_BYTES` of distinct terms; with more parts than one the
index is read once a part.

Defined results: documents without a term, null or empty, count for nothing. An item without a term
finds nothing. Rows that share an id are separate documents and separate items. A document without an
id comes after those of equal score. An item without an id is an item. An empty corpus finds nothing.
Long texts are indexed whole by one worker; a window ends early at `POSTINGS` postings. Extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import stored
from tidemark.llm.textbytes import ALNUM, Batch, Numbers, group_starts, slices

WINDOW = 4096
POSTINGS = 2 << 20
ITEM_BYTES = 8 << 20
#: Postings of one file of the index, about.
FILE = 32 << 20


def counted(b: Batch, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, document, times) of each term of each document of a batch, by code."""
    codes = b.codes(numbers)
    order = np.argsort(codes, kind="stable")
    codes, doc = codes[order], b.doc[order]
    new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])])) if len(codes) else np.zeros(0, np.int64)
    return codes[new], doc[new], np.diff(np.append(new, len(codes)))


def term_bytes(codes: np.ndarray, numbers: Numbers) -> list[bytes]:
    long = list(numbers)
    return [long[c >> 8] if c & 0xFF == 0x0A else c.to_bytes(8, "little").rstrip(b"\0") for c in codes.tolist()]


def _slices(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of an array, from each start on, as binary values."""
    ends = np.append(starts, len(data)) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


class Filling:
    """The window that a task is putting together."""

    def __init__(self):
        self.numbers = Numbers()
        self.ids, self.sizes, self.found, self.docs, self.postings = [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        b = Batch(texts, ALNUM, lower=True)
        codes, doc, times = counted(b, self.numbers)
        self.found.append((codes, doc + self.docs, times))
        self.ids.append(ids)
        self.sizes.append(b.counts)
        self.docs += len(ids)
        self.postings += len(codes)

    def row_batch(self, number: int) -> pa.RecordBatch:
        """Rows (window, term, n_docs, n_terms, docs, times): the documents themselves without a term, then a row a term."""
        sizes, ids = np.concatenate(self.sizes).astype(np.int64), pa.concat_arrays(self.ids)
        kept = np.flatnonzero(sizes > 0)
        ids, sizes = ids.take(pa.array(kept)), sizes[kept]
        plain, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        by_id = np.lexsort((plain, null))
        place = np.zeros(self.docs, np.int64)
        place[kept[by_id]] = np.arange(len(kept))
        codes, doc, times = (np.concatenate(x) for x in zip(*self.found))
        doc = place[doc]
        order = np.lexsort((doc, codes))
        codes, doc, times = codes[order], doc[order].astype("<u2"), times[order]
        starts = group_starts(codes)
        width = "<u1" if times.max(initial=0) < 256 else "<u4"
        ids_row = np.where(null, 0, plain)[by_id].astype("<i8").tobytes(), np.where(null, -sizes, sizes)[by_id].astype("<i8").tobytes()
        counts = np.diff(np.append(starts, len(codes)))
        columns = [
            pa.array(np.full(1 + len(starts), number)),
            pa.array([b"", *term_bytes(codes[starts], self.numbers)], pa.binary()),
            pa.array(np.append(len(kept), counts).astype(np.int64)),
            pa.array(np.append(sizes.sum(), np.add.reduceat(times, starts) if len(starts) else []).astype(np.int64)),
            pa.concat_arrays([pa.array([ids_row[0]], pa.binary()), _slices(doc, starts)]),
            pa.concat_arrays([pa.array([ids_row[1]], pa.binary()), _slices(times.astype(width), starts)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["window", "term", "n_docs", "n_terms", "docs", "times"])


class Index(NamedTuple):
    """postings: by term and window; n: documents with a term; terms: all their terms; windows: how many."""

    postings: DataFrame
    n: int
    terms: int
    windows: int


def index_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW) -> Index:
    """The index of every term of every text, stored; window: documents in a window, 65,536 at most."""
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def build(batches):
        number, now = TaskContext.get().partitionId() << 32, Filling()
        for batch in batches:
            for a, z in slices(batch.column(1)):
                while a < z:
                    some = min(z, a + window - now.docs)
                    now.add(batch.column(0).slice(a, some - a), batch.column(1).slice(a, some - a))
                    a = some
                    if now.docs >= window or now.postings >= POSTINGS:
                        yield now.row_batch(number)
                        number, now = number + 1, Filling()
        if now.docs:
            yield now.row_batch(number)

    raw = stored(plain.mapInArrow(build, "window long, term binary, n_docs long, n_terms long, docs binary, times binary"))
    total = raw.agg(F.sum("n_docs"), *[F.sum(F.when(F.col("term") == b"", F.col(c))) for c in ("n_docs", "n_terms")], F.count(F.when(F.col("term") == b"", 1))).first()
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total[0] or 0) // FILE))
    postings = stored(raw.repartitionByRange(files, "term", "window").sortWithinPartitions("term", "window"))
    return Index(postings, total[1] or 0, total[2] or 0, total[3])


class Items(NamedTuple):
    """Of a part of the items: their ids; their terms' numbers with how often; the terms."""

    ids: list
    asked: list[list[tuple[int, int]]]
    terms: dict[bytes, int]


def item_parts(items: DataFrame, id_col: str, text_col: str, item_bytes: int) -> Iterator[Items]:
    """The items' terms, at most `item_bytes` of them at a time (or one item)."""
    kind = items.schema[id_col].dataType.simpleString()
    plain = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def terms(batches):
        for batch in batches:
            for a, z in slices(batch.column(1)):
                numbers = Numbers()
                codes, doc, times = counted(b := Batch(batch.column(1).slice(a, z - a), ALNUM, lower=True), numbers)
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(b.n_docs + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(term_bytes(codes[order], numbers), pa.binary()), pa.array(times[order].astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *lists], names=["id", "terms", "times"])

    part, size = Items([], [], {}), 0
    for r in plain.mapInArrow(terms, f"id {kind}, terms array<binary>, times array<long>").toLocalIterator():
        more = sum(map(len, r.terms)) + 16 * len(r.terms)
        if part.ids and size + more > item_bytes:
            yield part
            part, size = Items([], [], {}), 0
        part.ids.append(r.id)
        part.asked.append([(part.terms.setdefault(bytes(t), len(part.terms)), n) for t, n in zip(r.terms, r.times)])
        size += more
    yield part


class Scoring:
    """Scores windows for a part of the items; heaps: each item's best (score, -doc_id, doc_id) so far."""

    def __init__(self, asked: list[list[tuple[int, int]]], weights: list[int], n: int, terms: int, k: int):
        self.asked, self.weights, self.n, self.terms, self.k = asked, weights, n, terms, k
        self.heaps: list[list] = [[] for _ in asked]

    def open(self, ids: bytes, sizes: bytes) -> None:
        self.ids, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.null, self.lengths = sizes < 0, 25 + 75 * np.abs(sizes) * self.n // self.terms
        self.gains: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def term(self, t: int, docs: bytes, times: bytes) -> None:
        at = np.frombuffer(docs, "<u2").astype(np.int64)
        tf = np.frombuffer(times, "<u1" if len(times) == len(at) else "<u4").astype(np.int64)
        there = np.zeros(len(self.ids), bool)
        there[at] = True
        self.gains[t] = at, self.weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * self.lengths[at])), np.packbits(there)

    def close(self) -> None:
        """Traverses the window for each item."""
        scores, bits = np.zeros(len(self.ids), np.int64), np.zeros(-(-len(self.ids) // 8), np.uint8)
        for asked, heap in zip(self.asked, self.heaps):
            bits[:] = 0
            for t, times in asked:
                if own := self.gains.get(t):
                    at, gain, there = own
                    scores[at] += gain if times == 1 else times * gain
                    bits |= there
            reached = np.flatnonzero(np.unpackbits(bits, count=len(self.ids)))
            found = scores[reached]
            scores[reached] = 0
            good = found >= (heap[0][0] if len(heap) == self.k else 1)
            reached, found = reached[good], found[good]
            if len(found) > self.k:
                good = found >= np.partition(found, -self.k)[-self.k]  # ties with the k-th stay
                reached, found = reached[good], found[good]
            for i, s in zip(reached.tolist(), found.tolist()):
                entry = (s, -(2**64), None) if self.null[i] else (s, -int(self.ids[i]), int(self.ids[i]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)


def _best(index: Index, part: Items, k: int, id_kind: str) -> DataFrame:
    """(number of the item, item, doc_id, score): each task's k best."""
    spark = index.postings.sparkSession
    words = F.broadcast(spark.createDataFrame(list(part.terms.items()), "term binary, t int"))  # a part's terms: ITEM_BYTES at most
    rows = index.postings
    if len(part.terms) <= 500:
        rows = rows.where(F.col("term").isin(b"", *part.terms))  # few terms: only their part of the sorted table is read
    mine = rows.join(words, "term")
    held = {r.t: r.df for r in mine.groupBy("t").agg(F.sum("n_docs").alias("df")).collect()}
    weights = [math.floor(1000 * math.log((2 * index.n + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(part.terms))]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.windows // 64)
    own = rows.where(F.col("term") == b"").withColumn("t", F.lit(-1))
    by_window = own.unionByName(mine).select("window", "t", "docs", "times").repartition(tasks, "window").sortWithinPartitions("window", "t")
    asked, n, terms = part.asked, index.n, index.terms

    def score(batches):
        now, last = Scoring(asked, weights, n, terms, k), None
        for batch in batches:
            for w, t, docs, times in zip(*(c.to_pylist() for c in batch.columns)):
                if w != last:
                    if last is not None:
                        now.close()
                    now.open(docs, times)  # a window's documents come first
                    last = w
                else:
                    now.term(t, docs, times)
        if last is not None:
            now.close()
        found = [(i, x[2], x[0]) for i, heap in enumerate(now.heaps) for x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], names=["number", "doc", "score"])

    found = by_window.mapInArrow(score, "number long, doc long, score long")
    place = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(part.ids)), f"number long, item {id_kind}")
    return ranked.join(F.broadcast(names), "number").select("item", "rank", "doc", "score")


def search_postings(index: Index, items: DataFrame, item_id: str = "item_id", item_text: str = "text", *, k: int = 10, doc_id: str = "doc_id", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents of each item: (item_id, rank, doc_id, score), scores above 0, equal ones by ascending doc_id."""
    kind = items.schema[item_id].dataType.simpleString()
    parts = item_parts(items, item_id, item_text, item_bytes)
    part, following = next(parts), next(parts, None)
    found = _best(index, part, k, kind)
    if following is not None:  # each part searches by itself and is let go
        found = stored(found)
        while following is not None:
            found, following = found.unionByName(stored(_best(index, following, k, kind))), next(parts, None)
    return found.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, k: int = 10) -> DataFrame:
    """Indexes docs and searches them for each item."""
    return search_postings(index_postings(docs, id_col, text_col), items, item_id, item_text, k=k, doc_id=id_col)
