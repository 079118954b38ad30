"""Near duplicates by SimHash: a self-join of all fingerprints through a binary trie.

A fingerprint's bit is the majority of that bit in the hashes of the text's word shingles. Equal
fingerprints are one node from the start, so copies cost one row. The distinct ones are sorted and cut
into chunks of at most 2 K that share a prefix, K growing with their number n as n^0.6. A chunk is a
trie: a node is a run of the sorted fingerprints and knows which bits all of them share.

Two nodes are traversed together: the bits that both have fixed and that differ add up to an error
that all pairs below must have, and a pair of nodes over the budget is dropped with all below it. A
task first joins each chunk with itself. Then chunks meet in pairs, those alone whose shared bits are
within the budget: of c chunks about c * (number of ways to flip 4 of log2 c bits) / 2 pairs, which
hold some 200 bytes a document for 10^5 documents, 600 for 10^7 and 6 KB for 10^10. A chunk is sent
once for each 16 of its partners, so no task gets more than those.

No link is lost, and not all are made: documents that are in one component by what a task knows need
no further link between them, so a node pair all in one component is dropped as well. A dense group
costs as many links as it has members, not pairs. What tasks found is joined by connected components.

The driver gets the bits that each chunk shares (3 numbers for each of n^0.4 / 2 chunks), no
fingerprint. Heavy fingerprints and components, each 1/10,000 of the rows or more, are looked up by
broadcast.

Defined results: a text without words, or null, has fingerprint 0 and is linked like any other. A text
of fewer words than a shingle is one shingle. Rows that share an id are separate documents; null ids
are linked, but name no component (of rows without ids alone it is null). An empty table gives no rows.
A long text is hashed whole by one worker, shingles in runs of `SHINGLES`. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import looked_up, stored
from tidemark.llm.textbytes import PLAIN, Batch, slices

SEED = 42
SHINGLES = 1 << 17
#: Node pairs that are looked at together.
PAIRS = 1 << 17
#: Partners that a chunk meets in one task.
PARTNERS = 16


def shingle_places(b: Batch, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(the words joined by one space, where each shingle begins and ends there, each shingle's document)."""
    kept = np.zeros(len(b.buf), np.int8)
    kept[b.start] += 1
    np.add.at(kept, np.minimum(b.end + 1, len(b.buf) - 1), np.where(b.end + 1 < len(b.buf), -1, 0))
    joined = b.buf[np.cumsum(kept, dtype=np.int8) > 0]
    size = b.end - b.start
    start = np.cumsum(size + 1) - size - 1
    joined[start + size] = 0x20
    first, counts = b.first[:-1], b.counts
    per_doc = np.where(counts > 0, np.maximum(counts - width, 0) + 1, 0)
    doc = np.repeat(np.arange(b.n_docs), per_doc)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + np.repeat(first, per_doc)
    last = at + np.minimum(counts, width)[doc] - 1
    return joined.tobytes(), start[at], start[last] + size[last], doc


def fingerprints(texts: pa.Array, width: int = 4) -> np.ndarray:
    b = Batch(texts, PLAIN, lower=True)
    ones, total = np.zeros((b.n_docs, 64), np.int64), np.zeros(b.n_docs, np.int64)
    if len(b.start):
        data, start, end, doc = shingle_places(b, width)
        total = np.bincount(doc, minlength=b.n_docs)
        for a in range(0, len(doc), SHINGLES):
            z = min(len(doc), a + SHINGLES)
            h = np.fromiter((xxhash.xxh64_intdigest(data[s:e], SEED) for s, e in zip(start[a:z].tolist(), end[a:z].tolist())), np.uint64, z - a)
            own = doc[a:z]
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ones[own[edges]] += np.add.reduceat(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), edges, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


class Trie:
    """The binary trie of sorted, distinct fingerprints, paths without forks left out.

    Nodes by level from the root: lo, hi (the run of fingerprints below), left, right (-1: a leaf),
    every, some (AND and OR of the fingerprints below).
    """

    def __init__(self, f: np.ndarray):
        self.f = f
        lo, hi, nodes, done = np.zeros(1, np.int32), np.full(1, len(f), np.int32), [], 0
        while len(lo):
            forks = np.flatnonzero(hi - lo > 1)
            a, z = lo[forks], hi[forks]
            below = f[a] ^ f[z - 1]
            for s in (1, 2, 4, 8, 16, 32):
                below |= below >> np.uint64(s)
            cut = np.searchsorted(f, f[z - 1] & ~(below >> np.uint64(1))).astype(np.int32)  # the first with the highest bit in which they differ
            left = np.full(len(lo), -1, np.int32)
            left[forks] = done + len(lo) + 2 * np.arange(len(forks))
            nodes.append((lo, hi, left))
            done += len(lo)
            lo, hi = np.stack([a, cut], 1).reshape(-1), np.stack([cut, z], 1).reshape(-1)
        self.lo, self.hi, self.left = (np.concatenate(x) for x in zip(*nodes))
        self.right = np.where(self.left >= 0, self.left + 1, -1)
        edges = np.cumsum([0, *(len(x[0]) for x in nodes)])
        self.forks = [a + np.flatnonzero(self.left[a:z] >= 0) for a, z in zip(edges[-2::-1], edges[:0:-1])]  # from the deepest level up
        self.every = f[self.lo]
        self.some = self.every.copy()
        for i in self.forks:
            self.every[i] &= self.every[self.right[i]]
            self.every[i] &= self.every[self.left[i]]
            self.some[i] |= self.some[self.right[i]] | self.some[self.left[i]]
        self.same = ~(self.every ^ self.some)

    def labels(self, of: np.ndarray) -> np.ndarray:
        """What all fingerprints below a node have in common of their labels, or -1."""
        found = of[self.lo]
        for i in self.forks:
            x, y = found[self.left[i]], found[self.right[i]]
            found[i] = np.where(x == y, x, -1)
        return found


class Groups:
    """Components of what one task compares; of: each fingerprint's component, named by one of its members."""

    def __init__(self, of: np.ndarray):
        self.of = of

    def merge(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Joins the components of each pair; the pairs of components that were apart."""
        apart = x != y
        if not apart.any():
            return []
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = i = parent.get(up, up)
            return i

        merged = []
        for a, b in set(zip(np.minimum(x, y)[apart].tolist(), np.maximum(x, y)[apart].tolist())):
            a, b = root(a), root(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
                merged.append((a, b))
        if merged:
            old = np.array(sorted(parent), np.int64)
            new = np.array([root(i) for i in old.tolist()], np.int64)
            at = np.minimum(np.searchsorted(old, self.of), len(old) - 1)
            self.of = np.where(old[at] == self.of, new[at], self.of)
        return merged


def meet(a: Trie, b: Trie, groups: Groups, budget: int) -> Iterator[tuple[int, int]]:
    """The components that fingerprints of a and b join, as merged; b may be a. In `groups` those of b come behind those of a."""
    alone, shift = a is b, 0 if a is b else len(a.f)
    names = lambda: (x := a.labels(groups.of), x if alone else b.labels(groups.of[shift:]))
    known, stale, since = names(), False, 0
    todo = [(np.zeros(1, np.int32), np.zeros(1, np.int32))]
    while todo:
        p, q = todo.pop()
        if len(p) > PAIRS:
            half = len(p) // 2
            todo += [(p[half:], q[half:]), (p[:half], q[:half])]
            continue
        if stale and since > 4 * (len(a.lo) + len(b.lo)):
            known, stale, since = names(), False, 0
        since += len(p)
        x = known[0][p]
        error = np.bitwise_count((a.every[p] ^ b.every[q]) & a.same[p] & b.same[q])
        near = (error <= budget) & ((x < 0) | (x != known[1][q]))
        p, q = p[near], q[near]
        n, m = a.hi[p] - a.lo[p], b.hi[q] - b.lo[q]
        leaves = (n == 1) & (m == 1)
        if leaves.any():
            merged = groups.merge(groups.of[a.lo[p[leaves]]], groups.of[shift + b.lo[q[leaves]]])
            stale |= bool(merged)
            yield from merged
            p, q, n, m = (v[~leaves] for v in (p, q, n, m))
        if not len(p):
            continue
        more = []
        if alone:
            own = p == q
            i = p[own]
            more += [(a.left[i], a.left[i]), (a.right[i], a.right[i]), (a.left[i], a.right[i])]
            p, q, n, m = (v[~own] for v in (p, q, n, m))
        wide = n >= m
        i, j = p[wide], q[wide]
        more += [(a.left[i], j), (a.right[i], j)]
        i, j = p[~wide], q[~wide]
        more += [(i, b.left[j]), (i, b.right[j])]
        todo.append((np.concatenate([x[0] for x in more]), np.concatenate([x[1] for x in more])))


def chunk_size(n: int) -> int:
    return min(1 << 20, max(1024, math.ceil(2.3 * n**0.6)))


_CHUNK = "chunk long, every long, some long, prints binary, labels binary"


def chunks_of(nodes: DataFrame, n: int, budget: int) -> DataFrame:
    """Chunks of the distinct fingerprints (column fp) with what all share (every, some) and the component of each within its chunk; stored."""
    size = chunk_size(n)
    prefix = min(64, max(0, math.ceil(math.log2(max(1, n / size)))))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (4 * size))
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(2**63)))
    ordered = nodes.select("fp").repartitionByRange(parts, unsigned).sortWithinPartitions(unsigned)

    def chunk(f: np.ndarray, number: int) -> pa.RecordBatch:
        trie = Trie(f)
        groups = Groups(np.arange(len(f)))
        for _ in meet(trie, trie, groups, budget):
            pass
        shared = np.array([trie.every[0], trie.some[0]]).view(np.int64)
        row = [number, int(shared[0]), int(shared[1]), f.tobytes(), groups.of.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 2)], names=["chunk", "every", "some", "prints", "labels"])

    def build(batches):
        number, rest = TaskContext.get().partitionId() << 32, np.zeros(0, np.uint64)
        for batch in batches:
            rest = np.concatenate([rest, batch.column(0).to_numpy().view(np.uint64)])
            tops = rest >> np.uint64(64 - prefix) if prefix else np.zeros(len(rest), np.uint64)
            while len(rest) and (tops[0] != tops[-1] or len(rest) > 2 * size):
                z = min(int(np.searchsorted(tops, tops[0], "right")), 2 * size)
                yield chunk(rest[:z], number)
                number, rest, tops = number + 1, rest[z:], tops[z:]
        if len(rest):
            yield chunk(rest, number)

    return stored(ordered.mapInArrow(build, _CHUNK))


def links_of(chunks: DataFrame, budget: int) -> DataFrame:
    """(u, v): links between fingerprints that stand for their chunks' components; stored."""
    spark = chunks.sparkSession
    shared = [(r.chunk, r.every, r.some) for r in chunks.select("chunk", "every", "some").collect()]  # n^0.4 rows
    numbers, every, some = (np.array(x, np.int64) for x in (zip(*shared) if shared else ((), (), ())))
    fixed = ~(every ^ some)

    def partners(batches):
        for batch in batches:
            for number, a, o in zip(*(c.to_pylist() for c in batch.columns)):
                error = np.bitwise_count(((every ^ a) & fixed & ~(np.int64(a) ^ np.int64(o))).view(np.uint64))
                mine = np.where((numbers ^ number) & 1, numbers > number, numbers < number)  # each pair once, half of them on either side
                found = numbers[(error <= budget) & mine]
                part = np.arange(len(found)) // PARTNERS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number)), pa.array(part), pa.array(found), pa.array(np.arange(len(found)) % PARTNERS == 0)], names=["a", "part", "b", "first"])

    pairs = stored(chunks.select("chunk", "every", "some").mapInArrow(partners, "a long, part long, b long, first boolean"))
    side = lambda name: chunks.select(F.col("chunk").alias(name), F.col("prints").alias(f"prints_{name}"), F.col("labels").alias(f"labels_{name}"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.where("first").count() // 4)
    many = pairs.join(side("b"), "b").select("a", "part", "prints_b", "labels_b").repartition(tasks, "a", "part")
    one = pairs.where("first").join(side("a"), "a").select("a", "part", "prints_a", "labels_a").repartition(tasks, "a", "part")

    def compare(batches):
        known, trie = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                (fa, la, fb, lb) = (batch.column(c)[i].as_py() for c in ("prints_a", "labels_a", "prints_b", "labels_b"))
                if fa != known:
                    known, trie = fa, Trie(np.frombuffer(fa, np.uint64))
                other = Trie(np.frombuffer(fb, np.uint64))
                groups = Groups(np.concatenate([np.frombuffer(la, "<i4").astype(np.int64), np.frombuffer(lb, "<i4").astype(np.int64) + len(trie.f)]))
                both = np.concatenate([trie.f, other.f]).view(np.int64)
                found = np.array(list(meet(trie, other, groups, budget)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[found[:, 0]]), pa.array(both[found[:, 1]])], names=["u", "v"])

    jobs = many.join(one, ["a", "part"]).select("prints_a", "labels_a", "prints_b", "labels_b")
    return stored(jobs.mapInArrow(compare, "u long, v long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, budget: int = 4) -> DataFrame:
    """Per document: its id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Fingerprints link that differ in at most `budget` bits; width: words of a shingle.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def read(batches):
        for batch in batches:
            found = [fingerprints(batch.column(1).slice(a, z - a), width) for a, z in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["id", "fp"])

    def members(batches):
        for batch in batches:
            for prints, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = np.frombuffer(prints, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(f[np.frombuffer(labels, "<i4")])], names=["fp", "rep"])

    prints = stored(plain.mapInArrow(read, "id long, fp long"))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many")))
    rows, n = nodes.agg(F.coalesce(F.sum("many"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = max(1000, rows // 10_000)
    chunks = chunks_of(nodes, n, budget)
    linked = components(links_of(chunks, budget)).select(F.col("id").alias("rep"), F.col("component_id").alias("root"))
    rooted = chunks.select("prints", "labels").mapInArrow(members, "fp long, rep long").join(linked, "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    rooted = stored(rooted)
    least = stored(nodes.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    named = stored(looked_up(rooted, least, "root", "component_id", least.where(F.col("prints") >= heavy), F.col("fp")).select("fp", "component_id"))
    out = looked_up(prints, named, "fp", "component_id", nodes.where(F.col("many") >= heavy), F.coalesce("id", F.monotonically_increasing_id()))  # null ids spread as well
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
