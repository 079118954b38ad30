import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(t or "")]


def plain(docs, items, k=10):
    """Every document scored for every item."""
    docs = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("window, item_bytes, k", [(4096, 8 << 20, 10), (7, 900, 3)])
def test_ranks_equal_brute_force(spark, corpus, window, item_bytes, k):
    docs = [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()]
    long = [t for _, t in docs if len(words(t)) > 100]
    items = [("a", " ".join(long[0].upper().split()[5:40])), ("b", long[1]), ("c", "É́é naïve ÀÉ 12,b"), ("d", None), ("e", " ,"), ("f", "nothing-like: this"), (None, long[2][:50]), ("b", long[1]), ("g", "base edit120 EDIT121 0 1 1 1 abc")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, rank int")
    index = lexical.index_postings(corpus, window=window)
    got = lexical.search_postings(index, table, k=k, item_bytes=item_bytes)
    assert got.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, k)
    assert index.n == sum(bool(words(t)) for _, t in docs) and index.terms == sum(len(words(t)) for _, t in docs)


def test_equal_documents_rank_by_id(spark):
    docs = spark.createDataFrame([(i, "one two three" if i != 7 else "one") for i in range(40)] + [(None, "one two three")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "two"), (2, "one")], "item_id long, text string")
    got = lexical.rank_documents(docs, items).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 1] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 2] == [7, 0, 1, 2, 3, 4, 5, 6, 8, 9]  # the shortest first


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "two")], "doc_id long, text string")
    assert lexical.rank_documents(empty, items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []


def test_a_search_reads_its_terms_row_groups(spark, corpus):
    index = lexical.index_postings(corpus)
    items = spark.createDataFrame([(1, "abc edit121")], "item_id long, text string")
    plan = index.postings.where(index.postings.term.isin(b"", b"abc"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    assert lexical.search_postings(index, items).count() > 0


def test_window_bitsets_and_wide_counts():
    now = lexical.Filling()
    now.add(pa.array([5, None, 3], pa.int64()), pa.array(["a " * 300 + "longer-than-eight-letters", "a b", ""]))
    rows = now.row_batch(9).to_pylist()
    assert {r["term"]: (r["n_docs"], r["n_terms"]) for r in rows} == {b"": (2, 306), b"a": (2, 301), b"b": (1, 1), b"longer": (1, 1), b"than": (1, 1), b"eight": (1, 1), b"letters": (1, 1)}
    assert rows[0]["term"] == b""
    scoring = lexical.Scoring([[(0, 2), (1, 1)]], [1000, 1], 2, 306, 10)
    scoring.open(rows[0]["docs"], rows[0]["times"])
    by_term = {r["term"]: r for r in rows}
    for t, term in enumerate((b"a", b"b")):
        scoring.term(t, by_term[term]["docs"], by_term[term]["times"])
    scoring.close()
    m = [25 + 75 * n * 2 // 306 for n in (304, 2)]
    assert sorted(scoring.heaps[0]) == sorted([(2 * 1000 * (10**9 * 300 // (300_000 + 8 * m[0])), -5, 5), (2 * 1000 * (10**9 // (1000 + 8 * m[1])) + 10**9 // (1000 + 8 * m[1]), -(2**64), None)])
    assert np.frombuffer(rows[0]["times"], "<i8").tolist() == [304, -2]
