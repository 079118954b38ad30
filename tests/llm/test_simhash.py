import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import simhash

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_print(text, width=4):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(prints, budget=4):
    """Component of each place by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    named: dict = {}
    at = roots(prints)
    for r, (i, _) in zip(at, rows):
        named.setdefault(r, []).extend([] if i is None else [i])
    return sorted(((i, f"{p:016x}", min(named[r], default=None)) for (i, _), p, r in zip(rows, prints, at)), key=str)


def partition(labels):
    found: dict = {}
    for i, x in enumerate(labels):
        found.setdefault(x, set()).add(i)
    return sorted(map(sorted, found.values()))


def dense(rng, n, centres):
    """Fingerprints around a few centres, some of them far apart, with chains of close ones."""
    middle = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(middle)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints_of_odd_texts():
    rng = random.Random(3)
    texts = [None, "", " \n", "A", "one two three", "One\ttwo \n three  four", "É é\x85x 　 y", "x" * 500, " lead and trail ", *(" ".join(rng.choice(["ab", "Cd", "e" * 40, "f"]) for _ in range(rng.randint(1, 300))) for _ in range(40))]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts))] == [plain_print(t) for t in texts]


def test_long_texts_in_runs(monkeypatch):
    texts = ["a b c d e " * 300, None, "q w e r t y " * 50]
    whole = simhash.fingerprints(pa.array(texts))
    monkeypatch.setattr(simhash, "SHINGLES", 37)
    assert (simhash.fingerprints(pa.array(texts)) == whole).all()


@pytest.mark.parametrize("seed, pairs", [(1, 1 << 17), (2, 64)])
def test_trie_joins_equal_all_pairs(monkeypatch, seed, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(seed)
    f = dense(rng, 700, 12) + [0, 1, 2**64 - 1]
    f = sorted(set(f))
    trie = simhash.Trie(np.array(f, np.uint64))
    groups = simhash.Groups(np.arange(len(f)))
    merged = list(simhash.meet(trie, trie, groups, 4))
    assert partition(groups.of.tolist()) == partition(roots(f))
    assert len(merged) == len(f) - len(set(groups.of.tolist()))
    mask = [rng.random() < 0.5 for _ in f]  # two tries, each joined with itself first
    sides = [np.array([x for x, m in zip(f, mask) if m is flag], np.uint64) for flag in (True, False)]
    own = []
    for s in sides:
        g = simhash.Groups(np.arange(len(s)))
        list(simhash.meet(t := simhash.Trie(s), t, g, 4))
        own.append(g.of)
    both = simhash.Groups(np.concatenate([own[0], own[1] + len(sides[0])]))
    list(simhash.meet(simhash.Trie(sides[0]), simhash.Trie(sides[1]), both, 4))
    assert partition(both.of.tolist()) == partition(roots(np.concatenate(sides).tolist()))


def test_dense_group_is_not_compared_pair_by_pair(monkeypatch):
    rng = random.Random(5)
    f = np.array(dense(rng, 20_000, 1), np.uint64)
    looked = []
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (looked.append(len(x)), count(x))[1])
    trie = simhash.Trie(f)
    groups = simhash.Groups(np.arange(len(f)))
    list(simhash.meet(trie, trie, groups, 4))
    assert sum(looked) < len(f) ** 2 / 20


@pytest.mark.parametrize("size", [None, 5])
def test_components_equal_all_pairs(spark, corpus, monkeypatch, size):
    if size:
        monkeypatch.setattr(simhash, "chunk_size", lambda n: size)
        monkeypatch.setattr(simhash, "PARTNERS", 3)
    rows = [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_copies(corpus).collect()), key=str) == plain(rows)


def test_heavy_prints_and_chains(spark, monkeypatch):
    """Copies in thousands, a chain of texts each near the next, null ids, extra columns."""
    base = [f"w{i}" for i in range(400)]
    chain = []
    for i in range(60):
        base[(i * 7) % 400] = f"z{i}"
        chain.append(" ".join(base))
    rows = [(i, "the same text each time") for i in range(500, 1900)] + [(i, t) for i, t in enumerate(chain)] + [(None, chain[3]), (None, "alone in the world of words"), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id long, fp long").repartition(6)
    got = sorted(map(tuple, simhash.near_copies(docs).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(empty):
    assert simhash.near_copies(empty).collect() == []
