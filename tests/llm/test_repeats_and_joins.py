import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import jaccard_join, substring_dedup
from tidemark.llm.components import _large, components
from tidemark.llm.jaccard_join import link
from tidemark.llm.shared import stored
from tidemark.llm.textbytes import PLAIN, Batch, Layout, ints_from_bytes, ints_to_bytes, windows

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(t):
    return SEP.findall(t or "")


def brute_repeats(rows, span=13):
    first = {}
    for i, t in rows:
        w = plain_words(t)
        if i is not None:
            for p in range(len(w) - span + 1):
                k = tuple(w[p : p + span])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = plain_words(t)
        gone = set()
        if i is not None:
            for p in range(len(w) - span + 1):
                if first[tuple(w[p : p + span])] < i:
                    gone |= set(range(p, p + span))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_repeats_equal_brute_force(corpus, group_bytes):
    rows = [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(corpus, group_bytes=group_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)
    assert any(r[2] for r in brute_repeats(rows))


def test_repeats_text_and_carried_columns(corpus):
    got = substring_dedup.remove_repeats(corpus, with_text=True, carry=["source", "g"]).collect()
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert len(plain_words(r.kept_text)) == r.n_words - r.n_removed
    assert {r.source for r in got} == {"src0", "src1"}


def test_empty_tables(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.link(empty).count() == 0


def brute_links(rows, width=5, percent=75):
    sets = []
    for i, t in rows:
        w = plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} if w else set()))
    label = {i: i for i, _ in sets if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=str)


@pytest.mark.parametrize("rare", [8, 1])
def test_links_equal_brute_force(corpus, rare):
    rows = [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()]
    got = jaccard_join.link(corpus, rare=rare, group_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


def test_links_at_the_threshold(spark):
    """Chains, thresholds met exactly, and outliers of a group: all must agree with every pair's comparison."""
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(64)]
    rows = []
    for i in range(90):
        w = list(base[: 40 + i % 24])
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + n, " ".join(base[:n])) for n in range(1, 12)]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), rare=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


def test_rows_that_share_an_id_are_one_node(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (3, c), (7, c), (9, b + " x"), (2, "other words here")]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120, unique=True), st.lists(st.integers(0, 400), max_size=60, unique=True), st.integers(0, 60))
def test_linked_sets_share_a_signature(shared, more, drop):
    """The prefix lemma: whatever class tokens are in, two sets that reach the threshold meet in a signature."""
    a, b = set(shared), set(shared[drop:]) | set(more[:10])
    if not a or not b or 100 * len(a & b) < 75 * len(a | b):
        return
    from tidemark.llm.textbytes import mix

    def sign(s, other):
        unshared = sorted(x for x in s if x not in other)
        hashes = mix(np.array(sorted(x for x in s if x in other), np.uint64))
        frequent = hashes % np.uint64(3) > 0
        order = np.lexsort((hashes, frequent))
        n = len(s)
        return set() if len(unshared) > n - -(-75 * n // 100) else set(jaccard_join.signatures(hashes[order], frequent[order], len(unshared), 75).tolist())

    assert sign(a, b) & sign(b, a)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 300)] + [(7, 7), (500, 501), (501, 500)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(200, 300)}, 501: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_of_a_batch(texts):
    b = Batch(pa.array(texts, pa.string()), PLAIN)
    words = [b.word(i).decode() for i in range(len(b.start))]
    assert [words[a:z] for a, z in zip(b.first[:-1], b.first[1:])] == [plain_words(t) for t in texts]
    h = b.hashes()
    assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words)) == len(set(h.tolist()))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.integers(1, 10**7), st.integers(1, 50))
def test_packed_lists_round_trip(values, n_words, groups):
    layout = Layout(n_words, groups, 3, per_bucket=1000)
    keys = np.unique(layout.keys(np.array(values, np.uint64)))
    back = [layout.unpack(layout.pack(keys[a:z]), k) for k, a, z in layout.split(keys)]
    assert (np.concatenate(back) == keys).all()
    ids = np.array(values, np.uint64).view(np.int64)
    assert (ints_from_bytes(ints_to_bytes(ids)) == ids).all()


def test_window_hashes_depend_on_all_words():
    h = np.arange(40, dtype=np.uint64)
    for width in (1, 5, 7, 13):
        w = windows(h, width)
        assert len(w) == 41 - width and len(set(w.tolist())) == len(w)
        assert (windows(h[3:], width) == w[3:]).all()


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_meet_in_polynomial_hashes(spark):
    """Two words of 1,024 letters that every polynomial hash modulo a power of two takes for one."""
    a, b = thue_morse(10)
    tail = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, a), (4, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str) == brute_repeats(rows)
    assert sorted(map(tuple, jaccard_join.link(docs).collect()), key=str) == brute_links(rows)


def test_windows_whose_keys_meet_are_told_apart(corpus):
    """With no bits of the first hash left the second one decides, and results stay exact."""
    run = substring_dedup.Repeats(7, 13, 1, 1)
    keys, checks = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    from tidemark.llm.textbytes import runs_of

    order, starts = runs_of(keys, checks)
    assert [sorted(order[a:z].tolist()) for a, z in zip(starts, [*starts[1:], 4])] == [[0, 2], [1], [3]]
    t = pa.table({"k": [0, 0], "g": [1, 2], "data": [run.repeats.pack(keys[:1]), run.repeats.pack(keys[:1])], "more": [substring_dedup._checks_to_bytes(checks[:1]) + ints_to_bytes(np.array([3])), substring_dedup._checks_to_bytes(checks[1:2]) + ints_to_bytes(np.array([8]))]})
    assert run.match_windows((pa.scalar(0),), t).num_rows == 0


def test_template_pages_make_no_pairs(spark, monkeypatch):
    """Pages of one template with texts of their own, of similarity 0.67: none is compared with all others."""
    import random

    rng = random.Random(3)
    template = [f"t{rng.randrange(900)}" for _ in range(400)]
    rows = [(i, " ".join(template + [f"o{rng.randrange(900)}" for _ in range(90)])) for i in range(400)]
    compared = []
    verify = jaccard_join.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.component_id == r.doc_id for r in got.collect())
    assert sum(compared) < 50 * len(rows)


def test_null_ids_and_equal_rows(spark):
    """Rows without an id are kept as they are; many equal rows of one id are one document."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 40 + [(7, text)] * 40 + [(9, text + " more"), (None, None), (8, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept_text string")
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str) == brute_repeats(rows)
    assert sorted(map(tuple, jaccard_join.link(docs).collect()), key=str) == brute_links(rows)


def test_a_hub_of_a_third_of_the_links_is_split(spark):
    """A hub's links are joined with its smallest neighbour from two plain shuffles, which adaptive execution splits."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id + 100 END AS u", "id + 200000 AS v")
        step = _large(stored(rows))
        assert len(step.collect()) > 50_000
        assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_of_one_id_are_dealt_by_their_texts(spark, words):
    """An id that most rows share: its rows lie in many groups and are one node all the same."""
    rng = random.Random(3)
    rows = [(5, " ".join(rng.choice(words) for _ in range(40))) for _ in range(200)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, rows[7][1] + " more"), (300, "nothing like it at all here")]
    got = {r.doc_id: r.component_id for r in link(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=1000).collect()}
    assert got == {5: 5, **{100 + k: 5 for k in range(5)}, 200: 5, 300: 300}
