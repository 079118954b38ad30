"""Hashed features of whole texts, sparse training rows, and bounded samples of labelled documents.

Only the fitting of a model uses a sample; its bound, `rows`, is a parameter of each operator. The
sample is the rows whose hash (of id, text and label together) is below a threshold, so it is spread
over the whole table and the same wherever the rows lie; null and repeated ids neither fill it nor
multiply it, and equal rows count once. Features are counted where the texts are; what reaches the
driver is at most twice `rows` sparse histograms of at most one entry a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import ALNUM, Batch, slices

_GOLDEN = np.uint32(0x9E3779B1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Grams:
    """Hashes of byte n-grams. words: of lower-cased letters within a word and its two borders; else of the text as it is, and a bucket each for a word that repeats the one, or the one but one, before."""

    def __init__(self, bits: int, sizes: tuple[int, ...], words: bool):
        self.bits, self.sizes, self.words = bits, sizes, words

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each n-gram by size in turn, the document of each): the n-grams of one size stand together."""
        b = Batch(pc.utf8_lower(texts) if self.words else texts)
        buf = np.where(_LETTER[b.buf], b.buf, np.uint8(0x20)) if self.words else b.buf
        doc_of = np.repeat(np.arange(b.n_docs, dtype=np.int32), np.diff(b.doc_at))
        buckets, docs = [], []
        for n in self.sizes:
            m = len(buf) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            inside = doc_of[:m] == doc_of[n - 1 :]
            for i in range(n):
                h = (h ^ buf[i : i + m]) * _GOLDEN
                if self.words and 0 < i < n - 1:
                    inside &= buf[i : i + m] != 0x20
            at = np.flatnonzero(inside)
            buckets.append(h[at] >> np.uint32(32 - self.bits))
            docs.append(doc_of[at])
        if not self.words:
            h = b.hashes()
            for back in (1, 2):
                again = np.flatnonzero((h[back:] == h[:-back]) & (b.doc[back:] == b.doc[:-back])) + back
                again = np.repeat(again, (b.end - b.start)[again])  # by bytes, as the n-grams
                buckets.append(np.full(len(again), (back * int(_GOLDEN)) % 2**32 >> (32 - self.bits), np.uint32))
                docs.append(b.doc[again].astype(np.int32))
        return (np.concatenate(buckets), np.concatenate(docs)) if buckets else (np.zeros(0, np.uint32), np.zeros(0, np.int32))

    def sums(self, texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document: the sum of its n-grams' rows of weights, and their number."""
        buckets, docs = self.of(texts)
        n = len(texts)
        out = np.stack([np.bincount(docs, weights[buckets, c], n) for c in range(weights.shape[1])], axis=1)
        return out, np.bincount(docs, minlength=n)


class Terms:
    """Hashes of the words of the lower-cased text (digits, a-z, bytes from 0x80), and of their beginnings of `heads` bytes."""

    heads = (4, 5, 6)

    def __init__(self, bits: int):
        self.bits = bits

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        b = Batch(texts, ALNUM, lower=True)
        found, docs = [b.hashes()], [b.doc]
        for n in self.heads:
            longer = np.flatnonzero(b.end - b.start > n)
            found.append(~b.hashes_of(b.start[longer], b.start[longer] + n))  # not a word's own hash
            docs.append(b.doc[longer])
        return (np.concatenate(found) >> np.uint64(64 - self.bits)).astype(np.uint32), np.concatenate(docs)


def batches_of(batch: pa.RecordBatch, column: int, most: int = 512 << 10):
    for a, z in slices(batch.column(column), most):
        yield a, z, batch.column(column).slice(a, z - a)


#: The hash space of `place`.
PLACES = 1_000_003


def place(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PLACES))


def bounded(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """About `rows` distinct values of the key columns, chosen by hash, and never more than twice that: df holds only the key columns."""
    n = df.agg(F.approx_count_distinct(F.xxhash64(*key))).first()[0]
    some = df.where(place(*key) < max(1, round(PLACES * rows / n))) if n > rows else df
    return some.distinct().orderBy(F.xxhash64(*key), *key).limit(2 * rows)


class Sparse:
    """Rows of (bucket, count) with a label each, sorted so that repeated runs give the same model."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (bytes(r[0]), bytes(r[1]), str(r[2])))
        self.labels = [r[2] for r in rows]
        self.index = [np.frombuffer(r[0], np.uint32).astype(np.int64) for r in rows]
        self.value = [np.frombuffer(r[1], np.uint32).astype(np.float64) for r in rows]

    def __len__(self) -> int:
        return len(self.labels)

    def part(self, rows: np.ndarray, norm: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, values, row of each) of these rows. norm: 'mean' (sums to 1) or 'any' (1 for what occurs)."""
        index = np.concatenate([self.index[r] for r in rows]) if len(rows) else np.zeros(0, np.int64)
        value = [self.value[r] / max(1.0, self.value[r].sum()) if norm == "mean" else np.ones(len(self.value[r])) for r in rows]
        return index, np.concatenate(value) if len(rows) else np.zeros(0), np.repeat(np.arange(len(rows)), [len(self.index[r]) for r in rows])


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """One row (text, label, h) of those that share id, text and label; h: their hash. labelled: (id, text, label)."""
    keyed = labelled.withColumn("h", F.xxhash64("id", "text", "label"))
    return keyed.groupBy("h").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label", "h")


def training_rows(labelled: DataFrame, features, most: int) -> Sparse:
    """labelled: (text, label as string, h), sampled already; the `most` smallest h at most reach the driver."""

    def count(batches):
        for batch in batches:
            for a, z, texts in batches_of(batch, 0):
                buckets, docs = features.of(texts)
                order = np.argsort(docs, kind="stable")
                cuts = np.searchsorted(docs[order], np.arange(z - a + 1))
                found = [np.unique(buckets[order[s:e]], return_counts=True) for s, e in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([u.astype(np.uint32).tobytes() for u, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary()), batch.column(1).slice(a, z - a), batch.column(2).slice(a, z - a)], names=["index", "value", "label", "h"])

    return Sparse(labelled.mapInArrow(count, "index binary, value binary, label string, h long").orderBy("h").limit(most).collect())
