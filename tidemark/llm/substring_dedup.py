"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 7 words, which are indexed; every
rolling window of 7 words probes that index. A repeat of 13 words holds one whole block of either
copy, so each repeat has a hit in both. Hits are extended: the 13-word windows around a hit are
hashed anew and matched, so overlapping matches join to the maximal exact repeat.

Documents are dealt into groups by id. A group sends each distinct key once, sorted and packed
(about 3.5 bytes a window), to the reducer of its hash range; a reducer answers with one bit for
each key of the list. So a passage that a third of all documents share is one key per group, no
group of copies meets in one task, and nothing is broadcast or collected. The text is shuffled once.

7-word keys are only a filter (24 bits and more: 24 and the binary logarithm of a group's words and
of the number of ranges). Whether words go is decided by two hashes of the 13 words that share
nothing: a key of 40 bits and that logarithm (45 bits at 100 words, 58 at 4 MB, 64 at 100 TB), and a
check of 48 bits beside it, so 93 to 112 bits in all, under a key drawn for each run. The words
themselves are not sent, as 13 words cost some 70 bytes a window.

Defined results: a null or empty text has no words and keeps ''. Rows with a null id neither lose
words nor serve as sources; they are not dealt to groups. Rows that share an id are one document's
pieces: neither is a source for the other. Ties don't arise, as sources have smaller ids. A very long
text is hashed whole by one worker, at some 40 bytes of memory a byte. An empty table gives an empty
result. Other columns are ignored, or passed through unchanged if named in `carry`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import volume
from tidemark.llm.textbytes import Batch, Layout, bits, group_starts, ints_from_bytes, ints_to_bytes, member, new_key, runs_of, slices, unbits, whole_windows

LISTS = "k int, g int, kind int, data binary, more binary"
REPLIES = "g int, kind int, k int, data binary, checks binary"
#: Bytes of the second hash of a window.
CHECK_BYTES = 6


def _checks_to_bytes(checks: np.ndarray) -> bytes:
    return np.ascontiguousarray(checks).view(np.uint8).reshape(-1, 8)[:, :CHECK_BYTES].tobytes()


def _checks_from_bytes(data: bytes) -> np.ndarray:
    full = np.zeros((len(data) // CHECK_BYTES, 8), np.uint8)
    full[:, :CHECK_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, CHECK_BYTES)
    return full.view(np.uint64)[:, 0]


def _no_rows(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_LISTS_ARROW = pa.schema([("k", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
_REPLIES_ARROW = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("k", pa.int32()), ("data", pa.binary()), ("checks", pa.binary())])


class Repeats:
    """The parameters of one run, and what its tasks do."""

    def __init__(self, block: int, span: int, words: int, groups: int):
        self.key = new_key()
        if span < 2 * block - 1:
            raise ValueError("a repeat must be long enough to hold a whole block: span >= 2 * block - 1")
        self.block, self.span = block, span
        self.anchors = Layout(words, groups, 3 if words < 2**34 else 4)
        self.repeats = Layout(max(1, words // 4), groups, 5)

    def _hash_group(self, texts: pa.ChunkedArray, both: bool = False):
        """For each run of rows that fits memory well: (first row, batch, word hashes)."""
        for a, z in slices(texts):
            b = Batch(texts.slice(a, z - a))
            yield a, b, b.hashes(self.key, both)

    def _windows(self, b: Batch, hashes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, keys, checks) of the windows of `span` words."""
        at, w, other = whole_windows(b, self.span, *hashes)
        return at, self.repeats.keys(w), other & np.uint64(2 ** (8 * CHECK_BYTES) - 1)

    # -- the index and its probes

    def _anchor_keys(self, t: pa.Table, both: bool = False):
        """Sorted distinct probe keys of a group, which of them are some block's, and which occur in two documents; and each window's (row, position in the batch, index of its key)."""
        rows, aligned, keys, where = [], [], [], []
        for a, b, h in self._hash_group(t["text"], both):
            at, w = whole_windows(b, self.block, h[0] if both else h)
            rows.append(a + b.doc[at])
            aligned.append((at - b.first[b.doc[at]]) % self.block == 0)
            keys.append(self.anchors.keys(w))
            where.append((a, b, h, at))
        rows, aligned, keys = np.concatenate(rows), np.concatenate(aligned), np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        starts = group_starts(ordered)
        return rows, aligned, keys, where, order, ordered, starts

    def send_anchors(self, key, t: pa.Table) -> pa.Table:
        g = key[0].as_py()
        ids = t["id"].to_numpy()
        rows, aligned, _, _, order, ordered, starts = self._anchor_keys(t)
        if not len(ordered):
            return _no_rows(_LISTS_ARROW)
        holders = ids[rows[order]]
        is_block = np.maximum.reduceat(aligned[order].view(np.uint8), starts)
        several = np.maximum.reduceat(holders, starts) != np.minimum.reduceat(holders, starts)
        distinct = ordered[starts]
        out = [(k, self.anchors.pack(distinct[a:z]), bits(is_block[a:z]) + bits(several[a:z])) for k, a, z in self.anchors.split(distinct)]
        n = len(out)
        return pa.table([[x[0] for x in out], [g] * n, [0] * n, [x[1] for x in out], [x[2] for x in out]], schema=_LISTS_ARROW)

    def match_anchors(self, key, t: pa.Table) -> pa.Table:
        """Of the keys of one hash range: those that are a block's and occur in two documents. One bit for each key of each list."""
        k = key[0].as_py()
        lists = [self.anchors.unpack(x.as_py(), k) for x in t["data"]]
        flags = [np.frombuffer(x.as_py(), np.uint8) for x in t["more"]]
        block = [np.unpackbits(f[: len(f) // 2], count=len(x)).astype(bool) for f, x in zip(flags, lists)]
        several = [np.unpackbits(f[len(f) // 2 :], count=len(x)).astype(bool) for f, x in zip(flags, lists)]
        ordered = np.sort(np.concatenate(lists))
        repeated = ordered[1:][ordered[1:] == ordered[:-1]]
        repeated = np.unique(np.concatenate([repeated, *[x[m] for x, m in zip(lists, several)]]))
        blocks = np.concatenate([x[m] for x, m in zip(lists, block)])
        shared = np.zeros(len(repeated), bool)
        if len(repeated) and len(blocks):
            at = np.searchsorted(repeated, blocks)
            at[at == len(repeated)] = 0
            shared[at[repeated[at] == blocks]] = True
        shared = repeated[shared]
        out = [(g.as_py(), m) for g, x in zip(t["g"], lists) if (m := member(x, shared)).any()]
        return pa.table([[g for g, _ in out], [0] * len(out), [k] * len(out), [bits(m) for _, m in out], pa.nulls(len(out), pa.binary())], schema=_REPLIES_ARROW)

    # -- hits and their extension

    def send_windows(self, key, t: pa.Table, replies: pa.Table) -> pa.Table:
        """The distinct windows around hits, each with the smallest id of the group that has it."""
        if not t.num_rows or not replies.num_rows:
            return _no_rows(_LISTS_ARROW)
        g, ids = key[0].as_py(), t["id"].to_numpy()
        _, _, keys, where, order, ordered, starts = self._anchor_keys(t, both=True)
        distinct = ordered[starts]
        hit = np.zeros(len(distinct), bool)
        marks = {k.as_py(): d.as_py() for k, d in zip(replies["k"], replies["data"])}
        for k, a, z in self.anchors.split(distinct):
            if k in marks:
                hit[a:z] = unbits(marks[k], z - a)
        flagged = np.empty(len(keys), bool)
        flagged[order] = np.repeat(hit, np.diff(np.append(starts, len(keys))))
        found, checks, of, done = [], [], [], 0
        for a, b, h, at in where:
            words = np.zeros(len(b.start) + 1, np.int64)
            words[at + 1] = flagged[done : done + len(at)]
            done += len(at)
            np.cumsum(words, out=words)
            p, keys_, other = self._windows(b, h)
            near = words[p + self.span - self.block + 1] > words[p]
            found.append(keys_[near])
            checks.append(other[near])
            of.append(ids[a + b.doc[p[near]]])
        found, checks, of = np.concatenate(found), np.concatenate(checks), np.concatenate(of)
        if not len(found):
            return _no_rows(_LISTS_ARROW)
        order, starts = runs_of(found, checks)
        least, found, checks = np.minimum.reduceat(of[order], starts), found[order][starts], checks[order][starts]
        out = [(k, self.repeats.pack(found[a:z]), _checks_to_bytes(checks[a:z]) + ints_to_bytes(least[a:z])) for k, a, z in self.repeats.split(found)]
        n = len(out)
        return pa.table([[x[0] for x in out], [g] * n, [1] * n, [x[1] for x in out], [x[2] for x in out]], schema=_LISTS_ARROW)

    def match_windows(self, key, t: pa.Table) -> pa.Table:
        """For each list, the windows that start in a document with a smaller id than the list's own."""
        k = key[0].as_py()
        lists, more = [self.repeats.unpack(x.as_py(), k) for x in t["data"]], t["more"].to_pylist()
        cuts = [CHECK_BYTES * len(x) for x in lists]
        checks = np.concatenate([_checks_from_bytes(m[:c]) for m, c in zip(more, cuts)])
        ids = np.concatenate([ints_from_bytes(m[c:]) for m, c in zip(more, cuts)])
        keys = np.concatenate(lists)
        order, starts = runs_of(keys, checks)
        least = np.minimum.reduceat(ids[order], starts)
        later = np.empty(len(keys), bool)
        later[order] = np.repeat(least, np.diff(np.append(starts, len(keys)))) < ids[order]
        ends = np.cumsum([len(x) for x in lists])[:-1]
        out = [(g.as_py(), self.repeats.pack(x[m]), _checks_to_bytes(c[m])) for g, x, c, m in zip(t["g"], lists, np.split(checks, ends), np.split(later, ends)) if m.any()]
        return pa.table([[x[0] for x in out], [1] * len(out), [k] * len(out), [x[1] for x in out], [x[2] for x in out]], schema=_REPLIES_ARROW)

    # -- removal

    def remove(self, key, t: pa.Table, replies: pa.Table, with_text: bool, names: list[str]) -> pa.Table:
        ids = t["id"].to_numpy()
        parts = [(b, a, *self._windows(b, h)) for a, b, h in self._hash_group(t["text"], both=True)]
        elsewhere = [(self.repeats.unpack(d.as_py(), k.as_py()), _checks_from_bytes(c.as_py())) for k, d, c in zip(replies["k"], replies["data"], replies["checks"])]
        every, checks = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
        own = ids[np.concatenate([a + b.doc[p] for b, a, p, *_ in parts])]
        # a window that the reply names starts in a document before all of the group's
        keys = np.concatenate([every, *[x[0] for x in elsewhere]])
        order, starts = runs_of(keys, np.concatenate([checks, *[x[1] for x in elsewhere]]))
        first = np.concatenate([own, np.full(len(keys) - len(own), np.iinfo(np.int64).min)])
        least = np.empty(len(keys), np.int64)
        if len(starts):
            least[order] = np.repeat(np.minimum.reduceat(first[order], starts), np.diff(np.append(starts, len(keys))))
        # the smallest id has no document before it, and no reply
        drop = least[: len(own)] < own
        kept, done = [], 0
        for b, _, p, *_ in parts:
            cover = np.zeros(len(b.start) + 1, np.int32)
            gone = p[drop[done : done + len(p)]]
            done += len(p)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + self.span, -1)
            kept.append(np.cumsum(cover)[:-1] <= 0)
        return pa.Table.from_arrays(rows_of(t, [x[0] for x in parts], kept, with_text, names), names=names)


def rows_of(t: pa.Table | pa.RecordBatch, parts: list[Batch], kept: list[np.ndarray], with_text: bool, names: list[str]) -> list:
    """The result's columns for the rows of t, whose texts are the parts in a row and whose kept words are marked."""
    n_words, n_removed, digests, texts = [], [], [], []
    for b, keep in zip(parts, kept):
        sums = np.concatenate([[0], np.cumsum(~keep)])
        n_words.append(b.counts)
        n_removed.append(sums[b.first[1:]] - sums[b.first[:-1]])
        for text in kept_texts(b, keep):
            digests.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode())
    columns = [t["id"], pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.array(digests, pa.string())]
    columns += [pa.array(texts, pa.string())] if with_text else []
    return columns + ([t["rest"]] if "rest" in names else [])


def kept_texts(b: Batch, keep: np.ndarray):
    """Each document's kept words, joined by one space."""
    edges = np.zeros(len(b.buf) + 1, np.int8)
    edges[b.start[keep]] += 1
    edges[b.end[keep] + 1] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    line = b.buf.copy()
    line[b.end] = 0x20
    kept = line[mask]
    at = np.concatenate([[0], np.cumsum(mask)])[b.doc_at]
    for a, z in zip(at[:-1], at[1:]):
        yield kept[a : max(a, z - 1)].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = 13, block: int = 7, group_bytes: int = 4 << 20, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Removes each word covered by a `span`-word window that also starts in a document with a smaller id.

    Returns id, n_words, n_removed, kept_sha256; with_text: kept_text; carry: those columns of the input.
    """
    size = volume(docs, text_col)
    group_bytes = max(group_bytes, min(32 << 20, size.bytes // 50_000))
    groups = max(1, -(-size.bytes // group_bytes), -(-size.rows // 100_000))
    run = Repeats(block, span, max(1, size.bytes // 5), groups)
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *rest)
    dealt = plain.where("id IS NOT NULL").withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))

    def own(f):
        return dealt.groupBy("g").applyInArrow(f, LISTS)

    anchors = own(lambda key, t: run.send_anchors(key, t)).groupBy("k").applyInArrow(lambda key, t: run.match_anchors(key, t), REPLIES)
    found = dealt.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(lambda key, t, r: run.send_windows(key, t, r), LISTS)
    gone = found.groupBy("k").applyInArrow(lambda key, t: run.match_windows(key, t), REPLIES)
    fields = [T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] if with_text else []
    fields += [T.StructField("rest", plain.schema["rest"].dataType)] if carry else []
    names = [f.name for f in fields]

    def untouched(batches):
        for batch in batches:
            for a, z in slices(batch.column(1)):
                b = Batch(batch.column(1).slice(a, z - a))
                yield pa.RecordBatch.from_arrays(rows_of(batch.slice(a, z - a), [b], [np.ones(len(b.start), bool)], with_text, names), names=names)

    out = dealt.groupBy("g").cogroup(gone.groupBy("g")).applyInArrow(lambda key, t, r: run.remove(key, t, r, with_text, names), T.StructType(fields))
    out = out.unionAll(plain.where("id IS NULL").mapInArrow(untouched, T.StructType(fields)))
    return out.select(*[f.name for f in fields if f.name != "rest"], *[F.col(f"rest.`{c}`").alias(c) for c in carry or []])
