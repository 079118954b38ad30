import hashlib
import zlib

import pytest

from tidemark.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def proof(tree, i):
    steps = []
    for nodes in tree[:-1]:
        a = i // 3 * 3
        steps.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
        i //= 3
    return steps


def plain(rows):
    """The manifest by itself, with lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: levels([x for _, x in groups[g]]) for g in names}
    top, out = levels([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, (r, own) in enumerate(groups[g]):
            steps = proof(trees[g], i) + proof(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at = leaf((*r[:4], r[4].replace("\n", ""))) if even else own
            for a, z in steps:
                at = h(a + at + z)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h("".join(a + z for a, z in steps)), at, at == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, sources):
    rows = [(i, sources(i), None if i % 11 == 0 else "en", None if i % 7 == 0 else i * 3, None if i % 13 == 0 else f"é line {i}\nnext" * (i % 3)) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "", None, None, ""), (3, "s0", "x", 1, "a\n"), (3, "s0", "x", 1, "a\n")] + [(None, "s1", "same", 1, "b\n")] * 25


@pytest.mark.parametrize("n, sources", [(1, lambda i: None), (400, lambda i: "s0" if i % 3 else f"s{i % 40}"), (700, lambda i: "s0")])
def test_manifest_equals_lists(spark, monkeypatch, n, sources):
    monkeypatch.setattr(merkle, "LEAVES", 20)  # many partitions: ragged edges at every level
    rows = rows_of(n, sources)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part int, leaf string").repartition(3)
    changed, where = merkle.without_line_feeds(docs)
    got = merkle.manifest(docs, changed=changed, where=where, proofs=True).collect()
    assert sorted((tuple(r[:7]) for r in got), key=str) == plain(rows)
    for r in got:
        assert merkle.fold(r.leaf, [s.asDict() for s in r.proof]) == r.root
        assert h("".join(s.left + s.right for s in r.proof)) == r.proof_sha256


def test_every_row_verifies_as_it_is(spark):
    docs = spark.createDataFrame(rows_of(60, lambda i: f"s{i % 4}"), "doc_id long, source string, lang string, n_chars long, text string")
    assert all(r.verified for r in merkle.manifest(docs).collect())


def test_empty_table_has_no_root(empty):
    changed, where = merkle.without_line_feeds(empty)
    assert merkle.manifest(empty, changed=changed, where=where).collect() == []


def test_span_knows_what_it_lacks():
    nodes = [h(str(i)).encode() for i in range(100)]
    tree = levels([x.decode() for x in nodes])
    for a, z in ((0, 100), (5, 50), (27, 54), (99, 100), (1, 2)):
        span = merkle.Span(nodes[a:z], a, 100)
        for k, known in enumerate(span.levels):
            assert [x.decode() for x in known] == tree[k][span.starts[k] : span.starts[k] + len(known)]
        lacking = set(span.missing())
        for leaf_at in range(a, z):
            i = leaf_at
            for k in range(span.top):
                i //= 3
                assert (span.run(k, i) is None) == ((k, i) in lacking)
