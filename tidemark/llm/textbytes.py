"""Words, hashes and packed key lists over whole batches of UTF-8 text, in numpy.

A batch of documents is one byte buffer in which each document is followed by a line feed; words,
their 64-bit hashes and the hashes of word windows are computed for the whole buffer at once.

Words of up to 8 bytes are hashed by a bijection of those bytes, so two of them never share a hash;
longer ones by BLAKE2b. A run that decides by hashes draws a key (`new_key`) on the driver and hands
it to its tasks: nobody can prepare texts whose hashes meet, and tasks that run again agree.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word separators of the plain words `[^\x20\x09-\x0D]+`.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased: digits, a-z, any byte from 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

try:
    _LIBC = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  absent outside glibc
except (OSError, AttributeError):
    _LIBC = None

_STEP = np.uint64(0xD1342543DE82EF95)
#: The key of hashes that only choose features.
PLAIN_KEY = b"\0" * 16


def new_key() -> bytes:
    return secrets.token_bytes(16)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits of the result (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Digests(dict):
    """Word -> 16 bytes of its keyed BLAKE2b, remembered by the process up to `most` words of at most 64 bytes."""

    most = 100_000

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16, key=self.key).digest()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = digest
        return digest


class Numbers(dict):
    """Word -> a number of its own; size: the words' bytes."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word)
        return self.setdefault(word, len(self))


_digests: dict[bytes, Digests] = {}


def _digests_of(key: bytes) -> Digests:
    if key not in _digests:
        _digests.clear()
        _digests[key] = Digests(key)
    return _digests[key]


class Batch:
    """Documents' bytes with their words.

    buf: the bytes, each document followed by a line feed; doc_at: where each document starts (one
    more entry than documents); start, end: of each word; doc: each word's document; first: each
    document's first word (one more entry than documents).
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, word_bytes: np.ndarray = PLAIN, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        lined = pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar("", texts.type), pa.scalar("\n", texts.type))
        self.n_docs = n = len(lined)
        offsets = np.frombuffer(lined.buffers()[1], np.int64, n + 1, lined.offset * 8) if n else np.zeros(1, np.int64)
        size = int(offsets[-1] - offsets[0])
        self.buf = np.frombuffer(lined.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        self.doc_at = offsets - offsets[0]
        if lower:
            self.buf = LOWER[self.buf]
        inside = np.zeros(size + 1, np.int8)
        inside[1:] = word_bytes[self.buf]
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.doc_at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def _first_bytes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each run's bytes as a number, and which runs that does not tell apart: those of over 8 bytes, or with a zero at the end."""
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.buf) + 1, "<u8", padded, strides=(1,))
        size = end - start
        spare = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        return (eight[start] << spare) >> spare, np.flatnonzero((size > 8) | (self.buf[end - 1] == 0))

    def _runs(self, start: np.ndarray, end: np.ndarray):
        data = self.buf.tobytes()
        return (data[a:z] for a, z in zip(start.tolist(), end.tolist()))

    def hashes(self, key: bytes = PLAIN_KEY, both: bool = False):
        """A 64-bit hash of each word; both: two that are independent."""
        return self.hashes_of(self.start, self.end, key, both)

    def hashes_of(self, start: np.ndarray, end: np.ndarray, key: bytes = PLAIN_KEY, both: bool = False):
        """A 64-bit hash of each run of bytes, none empty; both: two that are independent."""
        if not len(start):
            return (np.zeros(0, np.uint64), np.zeros(0, np.uint64)) if both else np.zeros(0, np.uint64)
        value, long = self._first_bytes(start, end)
        keys = np.frombuffer(key, np.uint64)
        h = mix(value ^ keys[0])
        other = mix(value * _STEP + keys[1]) if both else None
        if len(long):
            digests = _digests_of(key)
            found = np.frombuffer(b"".join(map(digests.__getitem__, self._runs(start[long], end[long]))), np.uint64).reshape(-1, 2)
            h[long] = found[:, 0]
            if both:
                other[long] = found[:, 1]
        return (h, other) if both else h

    def codes(self, numbers: Numbers) -> np.ndarray:
        """A code of each word, equal for equal words alone: its bytes, or its number among the longer words behind a byte that begins no word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        value, long = self._first_bytes(self.start, self.end)
        if len(long):
            value[long] = np.fromiter(map(numbers.__getitem__, self._runs(self.start[long], self.end[long])), np.uint64, len(long)) << np.uint64(8) | np.uint64(0x0A)
        return value

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def tidy() -> None:
    """Gives memory that is free again back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(texts: pa.Array | pa.ChunkedArray, most: int = 2 << 20):
    """(start, stop) runs of rows of at most `most` bytes of text each, or one row that is longer."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    at, ends, n = 0, np.cumsum(sizes), len(sizes)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop
    tidy()


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` word hashes from each position on; the last width - 1 positions have none. Runs of a power of two words are hashed from their halves."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:  # part: runs of `size` words
        if width & size:
            out = part[done : done + n] if out is None else mix(out * _STEP + part[done : done + n])
            done += size
        if size * 2 > width:
            return mix(out ^ np.uint64(width))
        part = mix(part[:-size] * _STEP + part[size:])
        size *= 2


def whole_windows(b: Batch, width: int, *hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(positions, hashes for each kind of word hashes) of the windows that lie in one document."""
    n = max(0, len(b.start) - width + 1)
    at = np.flatnonzero(b.doc[:n] == b.doc[width - 1 :]) if n else np.zeros(0, np.int64)
    return at, *(windows(h, width)[at] for h in hashes)


class Layout:
    """How 64-bit hashes are cut down to keys and packed into lists.

    A key is the hash's top bits: bucket (the reducer), slot, and `low` bytes. A list of a bucket's
    sorted keys is the number of keys in each slot and the low bytes; with about one key a slot a
    key takes low + 0.5 bytes. More groups or words change sizes only.
    """

    def __init__(self, words: int, groups: int, low: int, per_bucket: int = 1 << 20):
        self.low = low
        self.bucket_bits = min(24, max(0, int(np.ceil(np.log2(max(1, words / per_bucket))))))
        self.slot_bits = max(0, int(np.round(np.log2(max(1, words / groups / 2**self.bucket_bits)))))
        self.bits = self.bucket_bits + self.slot_bits + 8 * low
        if self.bits > 64:
            self.low, self.bits = low - 1, self.bits - 8

    def keys(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def split(self, keys: np.ndarray):
        """Yields (bucket, from, to) of the sorted keys."""
        if len(keys):
            buckets = (keys >> np.uint64(self.slot_bits + 8 * self.low)).astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(keys)]])
            for a, z in zip(edges[:-1], edges[1:]):
                yield int(buckets[a]), int(a), int(z)

    def pack(self, keys: np.ndarray) -> bytes:
        """One bucket's sorted keys."""
        slots = ((keys >> np.uint64(8 * self.low)) & np.uint64(2**self.slot_bits - 1)).astype(np.int64)
        counts = np.bincount(slots, minlength=2**self.slot_bits)
        wide = 1 if counts.max(initial=0) < 256 else 4
        low = keys.view(np.uint8).reshape(-1, 8)[:, : self.low]
        return bytes([wide]) + counts.astype(np.uint8 if wide == 1 else np.uint32).tobytes() + low.tobytes()

    def unpack(self, data: bytes, bucket: int) -> np.ndarray:
        wide, n = data[0], 2**self.slot_bits
        counts = np.frombuffer(data, np.uint8 if wide == 1 else np.uint32, n, 1)
        low = np.frombuffer(data, np.uint8, offset=1 + wide * n).reshape(-1, self.low)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, : self.low] = low
        slots = np.repeat(np.arange(n, dtype=np.uint64), counts)
        return keys.view(np.uint64)[:, 0] | (slots << np.uint64(8 * self.low)) | (np.uint64(bucket) << np.uint64(self.slot_bits + 8 * self.low))


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def runs_of(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where the runs of equal keys and checks begin in it)."""
    order = np.argsort(keys, kind="stable")
    apart = keys[order][1:] != keys[order][:-1]
    if (~apart & (checks[order][1:] != checks[order][:-1])).any():  # a key of two kinds of windows
        order = np.lexsort((checks, keys))
        apart = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    return order, np.flatnonzero(np.concatenate([[True], apart])) if len(keys) else np.zeros(0, np.int64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def ints_to_bytes(values: np.ndarray) -> bytes:
    """Signed integers as a base, a width in bytes and the differences from the base."""
    base = int(values.min(initial=np.iinfo(np.int64).max)) if len(values) else 0
    gap = values.astype(np.int64).astype(np.uint64) - np.uint64(base & (2**64 - 1))
    width = max(1, (int(gap.max(initial=0)).bit_length() + 7) // 8)
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + gap.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def ints_from_bytes(data: bytes) -> np.ndarray:
    base, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return (full.view(np.uint64)[:, 0] + np.uint64(base & (2**64 - 1))).view(np.int64)
