"""Benchmark decontamination by a distributed positional inverted index.

The corpus is cut into segments of documents; a segment is one row of a table in the shared folder:
its documents' ids and word offsets, every distinct word of its texts, and each word's sorted
positions (postings), packed as differences. Words stand there as they are, not as hashes.

Searching reads that table. A phrase all of whose words a segment has starts from the rarest one's
postings, less its offset in the phrase; the other words' postings are intersected with these starts
from the rarest up, and what is left is the phrase, word for word. Proximity starts from the same
postings: all words of the phrase, in any order, inside one run of `near` words of a document. All
phrases of a segment are intersected together, so what a segment costs grows with the postings of
rare words, not with a loop over phrases. Segments don't depend on each other: nothing is shuffled.

Test items go to the tasks in parts of at most `ITEM_BYTES` of text (8 MB; long items are cut into
pieces that overlap by a window less one word). A part is held as word numbers: some 13 bytes a word
and its distinct words, so 60 MB for words of one letter and 30 MB for prose. With more parts than one
the index is searched once per part, and what the parts found is joined by segment and document.

Defined results: null or empty texts have no words. Items without words are never found. An item
without an id counts as an item and has no place in the list of ids. Rows that share an id are
separate documents. Items that share an id count once. Equal windows of several items count for each.
No items: no hits. Documents longer than a segment's aim are a segment of their own, indexed whole by
one worker. Extra columns are ignored, or carried (they are stored beside the segment's ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import stored
from tidemark.llm.textbytes import ALNUM, Batch, Numbers, group_starts, slices
from tidemark.sources.store import LONG_ROWS

#: Bytes of test items that one search holds in each task.
ITEM_BYTES = 8 << 20
#: Candidates that are intersected at once.
CANDIDATES = 1 << 20


class Postings(dict):
    """One segment: first (each document's first word, and the end), terms, counts (places of each term), positions (of each term in turn), starts (of each term in positions)."""

    __getattr__ = dict.__getitem__


def invert(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, bytes]:
    """Documents' first words; the distinct words; how many of them need 1, 2, 3, 4 bytes a difference; their counts; the differences."""
    b = Batch(texts, ALNUM, lower=True)
    codes = b.codes(Numbers())
    order = np.argsort(codes, kind="stable")
    starts = group_starts(codes[order])
    counts = np.diff(np.append(starts, len(order)))
    gaps = np.diff(order, prepend=0)
    gaps[starts] = order[starts]
    most = np.maximum.reduceat(gaps, starts) if len(starts) else np.zeros(0, np.int64)
    width = 1 + (most >= 2**8) + (most >= 2**16) + (most >= 2**24)
    by_width = np.argsort(width, kind="stable")
    of = np.repeat(width, counts)
    packed = [gaps[of == w].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :w].tobytes() for w in (1, 2, 3, 4)]
    at = order[starts][by_width]
    data = b.buf.tobytes()
    terms = [data[s:e] for s, e in zip(b.start[at].tolist(), b.end[at].tolist())]
    return b.first, terms, np.bincount(width, minlength=5)[1:], counts[by_width], b"".join(packed)


def open_segment(first: np.ndarray, terms: pa.Array, widths: np.ndarray, counts: np.ndarray, packed: bytes) -> Postings:
    raw, gaps, at, done = np.frombuffer(packed, np.uint8), [], 0, 0
    for w, n in zip((1, 2, 3, 4), widths):
        size = int(counts[done : done + n].sum())
        full = np.zeros((size, 4), np.uint8)
        full[:, :w] = raw[at : at + w * size].reshape(-1, w)
        gaps.append(full.view("<u4")[:, 0].astype(np.int64))
        at, done = at + w * size, done + int(n)
    gaps = np.concatenate(gaps)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(gaps)])
    return Postings(first=first, terms=terms, counts=counts, starts=starts, positions=sums[1:] - np.repeat(sums[starts[:-1]], counts))


_INDEX = [("seg", T.LongType()), ("ids", T.ArrayType(T.LongType())), ("first", T.ArrayType(T.IntegerType())), ("terms", T.ArrayType(T.BinaryType())), ("widths", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.IntegerType())), ("postings", T.BinaryType())]
_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def index_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, segment_bytes: int = 8 << 20, carry: list[str] | None = None) -> DataFrame:
    """The index, a row per segment, stored; the columns of `carry` stand in it as one list each."""
    carry = carry or []
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"carried {i}") for i, c in enumerate(carry)])
    schema = T.StructType([*[T.StructField(*f) for f in _INDEX], *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in plain.schema.fields[2:]]])

    def build(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, z in slices(batch.column(1), segment_bytes):
                first, *rest = invert(batch.column(1).slice(a, z - a))
                row = [number, batch.column(0).slice(a, z - a), first, *rest]
                lists = [pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), c.slice(a, z - a)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(row, _ARROW)], *lists], names=[f.name for f in schema.fields])
                number += 1

    return stored(plain.mapInArrow(build, schema), LONG_ROWS)


class Phrases:
    """Test items as word numbers, and their windows.

    words: the number (place in vocabulary) of every item word; start, size: of each window in words;
    item: which of `ids` each window belongs to. Without a width an item is one window, however long.
    """

    def __init__(self, ids: list[str | None], texts: list[str | None], width: int | None):
        b = Batch(pa.array(texts, pa.string()), ALNUM, lower=True)
        codes, at, words = np.unique(b.codes(Numbers()), return_index=True, return_inverse=True) if len(b.start) else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.vocabulary = pa.array([b.word(i) for i in at], pa.binary())
        self.words = words.astype(np.int32)
        self.ids = list(dict.fromkeys(ids))
        item_of = {x: i for i, x in enumerate(self.ids)}
        width = max(1, int(b.counts.max(initial=0))) if width is None else width
        windows = np.where(b.counts > 0, np.maximum(b.counts - width, 0) + 1, 0)
        self.start = (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(b.first[:-1], windows)).astype(np.int32)
        self.size = np.repeat(np.minimum(b.counts, width), windows).astype(np.int32)
        self.item = np.repeat(np.array([item_of[x] for x in ids], np.int32), windows)


def candidates(s: Postings, p: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that a segment has all words of, in runs of one size: (size, windows, their terms, the order of their terms from the rarest up, and (which window, position of its rarest term))."""
    if not len(p.words) or not len(s.terms):
        return
    term_of = pc.fill_null(pc.index_in(p.vocabulary, value_set=s.terms), -1).to_numpy()
    terms = term_of[p.words]
    missing = np.concatenate([[0], np.cumsum(terms < 0)])
    there = np.flatnonzero(missing[p.start + p.size] == missing[p.start])
    for size in np.unique(p.size[there]):
        own = there[p.size[there] == size]
        for part in np.array_split(own, -(-len(own) // 50_000)):
            t = terms[p.start[part][:, None] + np.arange(size)]
            order = np.argsort(s.counts[t], axis=1, kind="stable")
            rarest = t[np.arange(len(t)), order[:, 0]]
            many = s.counts[rarest].astype(np.int64)
            runs = np.cumsum(many) // CANDIDATES
            for a, z in zip(cut := group_starts(runs), np.append(cut[1:], len(runs))):
                n = many[a:z]
                which = np.repeat(np.arange(a, z), n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield int(size), part, t, order, np.stack([which, s.positions[s.starts[rarest[which]] + within]])


def find(s: Postings, p: Phrases, near: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of each place of a window inside one document, as two rows; and (window, document) of its proximity matches, if near is given."""
    keys = np.append(np.repeat(np.arange(len(s.counts), dtype=np.int64) << 32, s.counts) + s.positions, np.iinfo(np.int64).max)  # term and position of all postings, sorted
    found, close = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for size, part, terms, order, (which, position) in candidates(s, p):
        start = position - order[which, 0]
        doc = np.searchsorted(s.first, position, "right") - 1
        inside = (start >= s.first[doc]) & (start + size <= s.first[doc + 1])
        w, x = which[inside], start[inside]
        for j in range(1, size):
            k = order[w, j]
            wanted = (terms[w, k].astype(np.int64) << 32) + x + k  # the next rarest word's postings, less its offset
            same = keys[np.searchsorted(keys, wanted)] == wanted
            w, x = w[same], x[same]
        found.append(np.stack([part[w], x]))
        if near:
            w, d = _close(s, keys, terms, order, which, position, doc, near)
            close.append(np.unique(np.stack([part[w], d]), axis=1))
    return np.concatenate(found, axis=1), np.unique(np.concatenate(close, axis=1), axis=1)


def _close(s: Postings, keys: np.ndarray, terms: np.ndarray, order: np.ndarray, which: np.ndarray, position: np.ndarray, doc: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, document) where a run of `near` words that holds the position has every term. keys: term and position of all postings, sorted, and an end."""

    def following(term, start):  # the term's first position from start on
        key = keys[np.searchsorted(keys, (term.astype(np.int64) << 32) + start)]
        return np.where(key >> 32 == term, key & (2**32 - 1), np.iinfo(np.int64).max)

    low, high = np.maximum(position - near + 1, s.first[doc]), np.minimum(position + near, s.first[doc + 1])
    for j in range(1, terms.shape[1]):
        term = terms[which, order[which, j]]
        ok = following(term, low) < high
        which, position, doc, low, high = which[ok], position[ok], doc[ok], low[ok], high[ok]
    hit = np.zeros(len(which), bool)
    for back in range(near):  # runs that begin so many words before the position
        rest = np.flatnonzero(~hit & (position - back >= s.first[doc]))
        for j in range(1, terms.shape[1]):
            begin = position[rest] - back
            end = np.minimum(begin + near, s.first[doc[rest] + 1])
            rest = rest[following(terms[which[rest], order[which[rest], j]], begin) < end]
        hit[rest] = True
    return which[hit], doc[hit]


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, Postings]]:
    for i in range(batch.num_rows):
        first, terms, widths, counts = (batch.column(c)[i].values for c in ("first", "terms", "widths", "counts"))
        yield i, open_segment(first.to_numpy().astype(np.int64), terms, widths.to_numpy(), counts.to_numpy(), batch.column("postings")[i].as_py())


def search_index(index: DataFrame, phrases: list[str], near: int | None = None) -> DataFrame:
    """(doc_id, phrase, kind, position): each exact place of a phrase (its number in the list), and with `near` a row for each document with a proximity match."""
    wanted = Phrases([str(i) for i in range(len(phrases))], phrases, None)

    def search(batches):
        for batch in batches:
            for i, s in _segments(batch):
                ids = batch.column("ids")[i].values
                (w, start), (w2, doc2) = find(s, wanted, near)
                doc = np.searchsorted(s.first, start, "right") - 1
                number = np.array([int(x) for x in wanted.ids], np.int32)[wanted.item[np.concatenate([w, w2])]]
                kinds = ["exact"] * len(w) + ["near"] * len(w2)
                places = pa.array(np.concatenate([start - s.first[doc], np.zeros(len(w2), np.int64)]), mask=np.array([k == "near" for k in kinds], bool))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate([doc, doc2]))), pa.array(number), pa.array(kinds, pa.string()), places], names=["doc_id", "phrase", "kind", "position"])

    return index.select(*[f[0] for f in _INDEX]).mapInArrow(search, "doc_id long, phrase int, kind string, position long")


def item_parts(items: DataFrame, id_col: str, text_col: str, width: int, item_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of pieces of the items, at most `item_bytes` of text each time; long items are cut where they are."""
    plain = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    most = max(1, item_bytes // 8)

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = [text]
                if text is not None and len(text) > most // 4:
                    b = Batch(pa.array([text]), ALNUM, lower=True)
                    pieces, a = [], 0
                    while a < len(b.start):  # a piece ends behind at most `most` bytes, or one window
                        z = max(a + width, int(np.searchsorted(b.end, b.start[a] + most, "right")))
                        pieces.append(b.buf[b.start[a] : b.end[min(z, len(b.end)) - 1]].tobytes().decode())
                        if z >= len(b.start):
                            break
                        a = z - width + 1
                for piece in pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([piece], pa.string())], names=["id", "text"])

    ids, texts, size = [], [], 0
    for r in plain.mapInArrow(cut, "id string, text string").toLocalIterator():
        n = 64 + len((r.text or "").encode())
        if ids and size + n > item_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.text)
        size += n
    yield ids, texts


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_FOUND = [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("close", T.ArrayType(T.StringType()))]


def _search(index: DataFrame, phrases: Phrases, near: int | None, named: bool) -> DataFrame:
    """A row per document: id, n_words, runs (hit words from, to), found and close (items), and the carried columns; named: only documents with a match, with seg and doc."""
    place = [T.StructField("seg", T.LongType()), T.StructField("doc", T.IntegerType())]
    others = [] if named else [T.StructField(f.name, f.dataType.elementType) for f in index.schema.fields[len(_INDEX) :]]
    schema = T.StructType([*(place if named else []), *_FOUND, *others])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    ids = np.array(phrases.ids, object)

    def listed(doc: np.ndarray, item: np.ndarray, n: int) -> list[list]:
        pairs = np.unique(np.stack([doc, item]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
        return [ids[x].tolist() for x in np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, n)))]

    def search(batches):
        for batch in batches:
            for i, s in _segments(batch):
                n = len(s.first) - 1
                (w, start), (close, close_doc) = find(s, phrases, near)
                doc = np.searchsorted(s.first, start, "right") - 1
                cover = np.zeros(int(s.first[-1]) + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + phrases.size[w], -1)
                inside = np.concatenate([np.cumsum(cover)[:-1] > 0, [False]]).astype(np.int8)
                edge = np.flatnonzero(np.diff(inside, prepend=0))
                runs: list[list] = [[] for _ in range(n)]
                for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    d = int(np.searchsorted(s.first, a, "right")) - 1
                    while a < z:  # a run may go on into the next document
                        stop = min(z, int(s.first[d + 1]))
                        if stop > a:
                            runs[d].append({"start": int(a - s.first[d]), "stop": int(stop - s.first[d])})
                        a, d = stop, d + 1
                columns = [batch.column("ids")[i].values, pa.array(np.diff(s.first), pa.int64()), pa.array(runs, run_type), *(pa.array(listed(d, phrases.item[x], n), pa.list_(pa.string())) for d, x in ((doc, w), (close_doc, close)))]
                columns += [batch.column(f.name)[i].values for f in others]
                if named:
                    keep = pa.array([bool(r) for r in runs]) if near is None else pc.or_(pc.greater(pc.list_value_length(columns[2]), 0), pc.greater(pc.list_value_length(columns[4]), 0))
                    columns = [c.filter(keep) for c in (pa.array([batch.column("seg")[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), *columns)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return index.mapInArrow(search, schema)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, width: int = 10, near: int | None = None, item_bytes: int = ITEM_BYTES, segment_bytes: int = 8 << 20, spans: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; with near also n_near_items, with spans also hit_spans (word from, to).

    An item's windows are its runs of `width` words, or the whole of a shorter item; a document's word inside any window is hit.
    near: items one of whose windows has all its words, in any order, inside a run of `near` words of the document.
    """
    carry = carry or []
    index = index_segments(docs, id_col, text_col, segment_bytes=segment_bytes, carry=carry)
    parts = item_parts(items, item_id, item_text, width, item_bytes)
    part, following = next(parts), next(parts, None)
    if following is None:
        found = _search(index, Phrases(*part, width), near, False)
    else:  # each part searches by itself and is let go; what they found is joined by document
        union = None
        while part is not None:
            one = stored(_search(index, Phrases(*part, width), near, True))
            union = one if union is None else union.unionByName(one)
            part, following = following, next(parts, None)
        flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        merged = union.groupBy("seg", "doc").agg(F.flatten(F.collect_list("runs")).alias("runs"), flat("found"), flat("close"))
        numbered = index.select("seg", F.posexplode("ids").alias("doc", "id"), "first", *[f.name for f in index.schema.fields[len(_INDEX) :]])
        every = numbered.select("seg", "doc", "id", (F.col("first")[F.col("doc") + 1] - F.col("first")[F.col("doc")]).cast("long").alias("n_words"), *[F.col(f"`carried {i}`")[F.col("doc")].alias(f"carried {i}") for i in range(len(carry))])
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        found = every.join(merged, ["seg", "doc"], "left").select("id", "n_words", none("runs", _RUNS), none("found", "array<string>"), none("close", "array<string>"), *[F.col(f"`carried {i}`") for i in range(len(carry))])
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(r["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["stop"]).alias("upto")),
        lambda s: s["n"],
    )
    out = [F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), F.size("found").cast("long").alias("n_items")]
    out += [F.sha2(F.array_join(F.array_sort("found"), ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")]
    out += [F.size("close").cast("long").alias("n_near_items")] if near else []
    out += [F.array_sort("runs").alias("hit_spans")] if spans else []
    return found.select(*out, *[F.col(f"`carried {i}`").alias(c) for i, c in enumerate(carry)])
