"""Packing by shortest-pack-first over the length histogram.

Texts become token ids, a final id is added, and documents longer than a sequence are cut at its
multiples. Only lengths matter for packing: the histogram (one count for each length up to the
sequence's) goes to the driver, which places lengths longest first, each into the packs with most
room, and splits a pattern's count where fewer pieces are left than packs. That gives at most two
patterns a length, whatever the number of documents. Pieces then get their place by rank: the r-th
piece of a length takes the r-th slot of that length.

Ranks are counted in slices of each length, dealt by the pieces' stored numbers, so a length, an id or
a text that a third of all pieces share is spread over many tasks. Ids themselves are never moved:
their checksum is taken where they are made.

Words are tokenized once per task: the tokenizer ends words at white space and between letters and
signs, so a text's ids are its pieces' ids in a row; a bounded memory of pieces saves most of the work.
Its keys are the pieces' bytes, not hashes.

Defined results: null or empty texts are the final id alone. Every row is a document of its own, also
those that share an id or have none. A text of over 4 MB is tokenized in parts of about 2 MB, cut at
spaces; its ids (4 bytes each at most) are held by one worker. Equal lengths are placed in any order.
An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored
from tidemark.llm.textbytes import LOWER, PLAIN, Batch, Numbers, slices, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def spread(counts: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest pack first: [(how many packs, their lengths)] for the histogram."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    most, done = [], []

    def put(count: int, pattern: tuple[int, ...], left: int) -> None:
        if not left:
            done.append((count, pattern))
            return
        if not open_packs.get(left):
            open_packs[left] = []
            heapq.heappush(most, -left)
        open_packs[left].append((count, pattern))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            if most and -most[0] >= length:
                left = -most[0]
                count, pattern = open_packs[left].pop()
                if not open_packs[left]:
                    heapq.heappop(most)
                used = min(todo, count)
                if count > used:
                    put(count - used, pattern, left)
                put(used, (*pattern, length), left - length)
            else:
                used = todo
                put(used, (length,), room - length)
            todo -= used
    return done + [x for packs in open_packs.values() for x in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, rank of the first piece, sequence of that piece, offset), sorted: where each length's pieces go by rank."""
    rows, base, taken = [], 0, {}
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), base, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


_APART = np.zeros(256, bool)  # bytes of words that are left whole: an apostrophe may join letters, < may open a special token
_APART[[0x27, 0x3C]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def pieces_of_words(b: Batch) -> Batch:
    """The batch's words cut where an ASCII letter meets an ASCII sign or digit, which always ends a token of the word_bpe tokenizer, and A-Z lower-cased, as it does itself; words with an apostrophe or < stay as they are."""
    marks = np.concatenate([[0], np.cumsum(_APART[b.buf])])
    apart = marks[b.end] > marks[b.start]
    raw = np.zeros(len(b.buf) + 1, np.int8)
    np.add.at(raw, b.start[apart], 1)
    np.add.at(raw, b.end[apart], -1)
    raw = np.cumsum(raw[:-1], dtype=np.int8).astype(bool)
    b.buf = np.where(raw, b.buf, LOWER[b.buf])
    letter = _LETTER[b.buf]
    cut = np.flatnonzero((letter[1:] != letter[:-1]) & (b.buf[1:] < 0x80) & (b.buf[:-1] < 0x80) & PLAIN[b.buf[1:]] & PLAIN[b.buf[:-1]] & ~raw[1:]) + 1
    b.start, b.end = np.sort(np.concatenate([b.start, cut])), np.sort(np.concatenate([b.end, cut]))
    b.first = np.searchsorted(b.start, b.doc_at)
    return b


class WordIds:
    """Token ids of pieces of words, remembered up to `most` pieces, `most_bytes` of the longer ones, and a batch's."""

    def __init__(self, path: str, most: int = 600_000, most_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known = Numbers(), {}
        self.at, self.size, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16 if len(self.ends) <= 2**16 else np.uint32), 0

    def _keep(self, codes: list[int], ids: np.ndarray, size: np.ndarray) -> None:
        n, at = len(self.known), self.used + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        while n + len(codes) > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(codes)], self.size[n : n + len(codes)] = at, size
        self.used += len(ids)
        self.known.update(zip(codes, range(n, n + len(codes))))

    def learn(self, codes: list[int], words: list[str]) -> None:
        """Pieces of Latin-1 letters are one word of the tokenizer, so many of them go as one text, cut again at the ids that end words; others go one by one.

        A word has one end at most, so as many ends as words are one each; texts with fewer go one by one as well.
        """
        plain = [bool(_LETTERS.fullmatch(w)) for w in words]
        for a in range(0, len(words), 20_000):
            part = range(a, min(a + 20_000, len(words)))
            one, rest = [i for i in part if plain[i]], [i for i in part if not plain[i]]
            runs = [one[j : j + 200] for j in range(0, len(one), 200)]
            for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(words[i] for i in run) for run in runs], add_special_tokens=False)):
                ids = np.array(e.ids, np.int64)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(run) and ends[-1] == len(ids):
                    self._keep([codes[i] for i in run], ids, np.diff(ends, prepend=0))
                else:
                    rest += run
            found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
            self._keep([codes[i] for i in rest], np.array([x for f in found for x in f], np.int64), np.array([len(f) for f in found], np.int64))

    def of(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """The batch's ids, and the number of each document's."""
        if len(self.known) > self.most or self.numbers.size > self.most_bytes:
            self.clear()
        b = pieces_of_words(b)
        distinct, first, inverse = np.unique(b.codes(self.numbers), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        self.learn([keys[i] for i in new], [b.word(first[i]).decode() for i in new])
        rows = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[inverse]
        size = self.size[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.at[rows] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[b.first])


def parts_of(text: pa.Array, most: int = 2 << 20) -> list[pa.Array]:
    """A long text (an array of one) in parts of about `most` bytes, cut behind a space or line feed."""
    data = np.frombuffer(text[0].as_py().encode(), np.uint8)
    spaces = np.flatnonzero((data == 0x20) | (data == 0x0A)) + 1
    at = np.unique(spaces[np.minimum(np.searchsorted(spaces, np.arange(most, len(data), most)), len(spaces) - 1)]) if len(spaces) else spaces
    return [pa.array([data[a:z].tobytes().decode()]) for a, z in zip(np.append(0, at), np.append(at, len(data)))]


_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00df]+")
_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own, made once."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def cut(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, room: int = 4096, final_id: int = 2) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, and a number of its own."""

    def tokenize(batches):
        words, number = word_ids(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, z in slices(batch.column(1)):
                texts = batch.column(1).slice(a, z - a)
                if z - a == 1 and (pc.binary_length(texts)[0].as_py() or 0) > 4 << 20:
                    ids = np.concatenate([words.of(Batch(part))[0] for part in parts_of(texts)])
                    counts = np.array([len(ids)])
                else:
                    ids, counts = words.of(Batch(texts))
                rows, at = [], 0
                for doc, n in zip(batch.column(0).slice(a, z - a).to_pylist(), counts.tolist()):
                    own = np.append(ids[at : at + n], ids.dtype.type(final_id)).astype("<u4")
                    at += n
                    rows += [(doc, s, min(room, n + 1 - s), zlib.crc32(own[s : s + room].tobytes()), n + 1) for s in range(0, n + 1, room)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*rows)], pa.array(np.arange(number, number + len(rows)))], names=[*_NAMES, "number"])
                number += len(rows)
        words.clear()  # the worker lives on
        tidy()

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(tokenize, f"{PIECES}, number long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, room: int = 4096, final_id: int = 2, slice_rows: int = 100_000) -> DataFrame:
    """The pieces with their sequence_id and offset in it."""
    pieces = stored(cut(docs, tokenizer_path, id_col, text_col, room=room, final_id=final_id))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `room` rows
    places = slots(spread(counts, room))
    n = max(8, -(-sum(counts.values()) // slice_rows))
    sliced = pieces.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(n)).cast("int"))  # numbers are stored, so every reader deals alike
    before = sliced.groupBy("length", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = sliced.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("number")) - 1)
    ranked = ranked.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])

    def place(batches):
        lengths, firsts = places[:, 0], places[:, 1]
        key = lengths * (int(firsts.max(initial=0)) + 1) + firsts if len(places) else lengths
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, length * (int(firsts.max(initial=0)) + 1) + np.minimum(rank, firsts.max(initial=0)), "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(places[at, 2] + rank - firsts[at]), pa.array(places[at, 3])], names=[*_NAMES, "sequence_id", "offset"])

    kept = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    return kept.mapInArrow(place, f"{PIECES}, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
