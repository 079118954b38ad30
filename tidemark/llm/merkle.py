"""A Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and a proof for each row.

Rows are dealt by sorted ranges of (group, id), so each group's leaves lie in consecutive partitions; a
table of how many rows of each group each partition holds, summed over the partitions before it, gives
every leaf its place in its group. A task then builds all complete aligned subtrees of its own leaves.
What is left at the edges of its range, a few nodes a level, is shuffled by coordinate (group, level,
run), and the upper levels are finished from there, a level at a time. The finished runs return to the
partitions that have leaves below them, where each leaf's proof is put together. The text of a row is
read once and never shuffled: 32 bytes stand for it. The tree over the groups' subroots is built by the
same jobs, so many groups are no other case than few.

A digest is the lower-case hex SHA-256 of its inputs put together. A run of `FANOUT` consecutive nodes,
the last run of a level maybe shorter, becomes one node, until one is left.

Defined results: a null field is `-`, any other its length in bytes, `:` and its value. A null group is a
group, the first. Rows without an id come first in their group; rows with equal ids are ordered by their
digests, and equal rows have equal proofs up to their places. Long texts are hashed whole by the scan.
An empty table has no root and no rows. Extra columns are ignored. A group of a third of all rows, or
equal rows in any number, spreads over as many partitions as its share: the sort ends with a number of
the row. Each stage reads a stored table and can be run again by itself.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import stored

FANOUT = 3
#: Leaves that a task works on; with proofs in the result, of some 2 KB each, a tenth of them.
LEAVES = 100_000
STEPS = "array<struct<left: string, right: string>>"


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def node(inputs: bytes) -> bytes:
    return sha256(inputs).hexdigest().encode()


def height(n: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def fold(leaf: str, steps: list[dict]) -> str:
    """The root that a leaf and its proof lead to."""
    at = leaf.encode()
    for s in steps:
        at = node(s["left"].encode() + at + s["right"].encode())
    return at.decode()


class Span:
    """The consecutive leaves of one group that one partition has, and the complete subtrees above them.

    levels[k]: the known nodes of level k; starts[k]: the first one's place in the level; sizes[k]: nodes of that level.
    """

    def __init__(self, leaves: list[bytes], start: int, total: int):
        self.top = height(total)
        self.first, self.last = start, start + len(leaves) - 1
        self.levels, self.starts, self.sizes = [leaves], [start], [total]
        for _ in range(self.top):
            known, s, n = self.levels[-1], self.starts[-1], self.sizes[-1]
            e = s + len(known)
            a = -(-s // FANOUT)
            z = -(-e // FANOUT) if e == n else e // FANOUT
            self.levels.append([node(b"".join(known[FANOUT * j - s : FANOUT * (j + 1) - s])) for j in range(a, z)])
            self.starts.append(a)
            self.sizes.append(-(-n // FANOUT))

    def ragged(self):
        """(level, place, digest) of known nodes whose parent isn't, the whole group's root among them."""
        for k in range(self.top):
            known, s = self.levels[k], self.starts[k]
            a, z = FANOUT * self.starts[k + 1], min(FANOUT * (self.starts[k + 1] + len(self.levels[k + 1])), s + len(known))
            for i, x in enumerate(known, s):
                if i < a or i >= max(a, z):
                    yield k, i, x
        if self.levels[-1]:
            yield self.top, 0, self.levels[-1][0]

    def missing(self):
        """(level, run) of the runs above these leaves that aren't complete here."""
        a, z = self.first, self.last
        for k in range(self.top):
            a, z = a // FANOUT, z // FANOUT
            s, e = self.starts[k + 1], self.starts[k + 1] + len(self.levels[k + 1])
            for r in [*range(a, min(s, z + 1)), *range(max(a, e), z + 1)] if e > s else range(a, z + 1):
                yield k, r

    def run(self, k: int, r: int) -> list[bytes] | None:
        s, known = self.starts[k + 1], self.levels[k + 1]
        return self.levels[k][FANOUT * r - self.starts[k] : FANOUT * (r + 1) - self.starts[k]] if s <= r < s + len(known) else None


def spans_of(leaves: pa.Table, control: pa.Table):
    """(control row, where its leaves begin, Span) of each group of a partition; leaves: in order."""
    data = [x.hex().encode() for x in leaves.column("digest").to_pylist()]
    for c in control.filter(pc.is_valid(control.column("n"))).sort_by("first_row").to_pylist():
        yield c, c["first_row"], Span(data[c["first_row"] : c["first_row"] + c["n"]], c["start"], c["total"])


_RAGGED = "part int, g string, top int, level int, idx long, digest binary"


def subtrees(_, leaves: pa.Table, control: pa.Table) -> pa.Table:
    """Nodes at the edges of what the partition can build, and (without a digest) the runs that it needs."""
    rows = []
    for c, _, span in spans_of(leaves.sort_by("row"), control):
        rows += [(c["part"], c["g"], span.top, k, i, bytes.fromhex(x.decode())) for k, i, x in span.ragged()]
        rows += [(c["part"], c["g"], span.top, k, r, None) for k, r in span.missing()]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "g", "top", "level", "idx", "digest"])


class Tree(NamedTuple):
    """leaves: (part, row, and what they were given with); control: by partition, its groups' spans and the runs that it needs; roots: (g, total, digest)."""

    leaves: DataFrame
    control: DataFrame
    roots: DataFrame


def build_tree(rows: DataFrame, by: list[str], leaves_a_task: int) -> Tree:
    """rows: stored, with g (group, not null), digest (32 bytes) and others; by: the columns that order a group's leaves, all rows apart."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // leaves_a_task))
    ordered = rows.repartitionByRange(parts, "g", *by).sortWithinPartitions("g", *by)
    leaves = stored(ordered.select("*", F.spark_partition_id().alias("part"), F.expr("monotonically_increasing_id() & 8589934591").alias("row")))
    counts = stored(leaves.groupBy("part", "g").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition that the group reaches
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    spans = stored(counts.withColumn("start", F.coalesce(before, F.lit(0))).join(totals, "g"))

    edges = stored(leaves.select("part", "row", "digest").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(subtrees, _RAGGED))
    nodes, needs = edges.where("digest IS NOT NULL").drop("part"), edges.where("digest IS NULL")
    tops = spans.agg(F.max("total")).first()[0]
    runs, pending, roots = None, nodes.where("level = 0"), nodes.where("level = top AND level = 0")
    for k in range(height(tops or 0)):
        run = pending.where("top > level").groupBy("g", "top", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        run = stored(run.select("g", "top", F.lit(k).alias("level"), "idx", F.col("kids.digest").alias("kids")))
        above = F.unhex(F.sha2(F.array_join(F.transform("kids", lambda x: F.lower(F.hex(x))), ""), 256))
        made = run.select("g", "top", F.lit(k + 1).alias("level"), "idx", above.alias("digest"))
        pending = nodes.where(F.col("level") == k + 1).unionByName(made)
        roots = roots.unionByName(pending.where("level = top"))
        runs = run if runs is None else runs.unionByName(run)
    blank = {c: F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("first_row", "long"), ("start", "long"), ("total", "long"), ("level", "int"), ("idx", "long"), ("kids", "array<binary>"))}
    control = spans.select("part", "g", "n", "first_row", "start", "total", blank["level"], blank["idx"], blank["kids"])
    if runs is not None:
        given = needs.select("part", "g", "level", "idx").join(runs.drop("top"), ["g", "level", "idx"])
        control = control.unionByName(given.select("part", "g", blank["n"], blank["first_row"], blank["start"], blank["total"], "level", "idx", "kids"))
    return Tree(leaves, control, stored(roots.join(totals, "g").select("g", "total", "digest")))


class Climb:
    """Proofs of a span's leaves. given: runs that other partitions finished; what two leaves share is put together once."""

    def __init__(self, span: Span, given: dict[tuple[int, int], list[bytes]], above: list[tuple[bytes, bytes]]):
        self.span, self.given, self.above = span, given, above
        self.rest = b"".join(x + y for x, y in above)
        self.memo: list[tuple] = [(-1,)] * span.top

    def siblings(self, k: int, i: int) -> bytes:
        if k == self.span.top:
            return self.rest
        if self.memo[k][0] != i:
            kids = self.span.run(k, i // FANOUT) or self.given[k, i // FANOUT]
            left, right = b"".join(kids[: i % FANOUT]), b"".join(kids[i % FANOUT + 1 :])
            self.memo[k] = (i, left, right, left + right + self.siblings(k + 1, i // FANOUT))
        return self.memo[k][3]

    def steps(self) -> list[tuple[bytes, bytes]]:
        """Of the leaf last asked for: what stands left and right of it, level by level."""
        return [*((m[1], m[2]) for m in self.memo), *self.above]


def climbs(leaves: pa.Table, control: pa.Table):
    """(g, the leaf's row, Climb that stands at it, its siblings) of every leaf."""
    given: dict[str, dict] = {}
    for r in control.filter(pc.is_valid(control.column("level"))).to_pylist():
        given.setdefault(r["g"], {})[r["level"], r["idx"]] = [x.hex().encode() for x in r["kids"]]
    for c, at, span in spans_of(leaves, control):
        above = [(s["left"].encode(), s["right"].encode()) for s in c.get("above") or ()]
        climb = Climb(span, given.get(c["g"], {}), above)
        for i in range(c["n"]):
            yield c, at + i, climb, climb.siblings(0, c["start"] + i)


def _group_paths(_, leaves: pa.Table, control: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("row")
    names, rows = leaves.column("name").to_pylist(), []
    for _, i, climb, _ in climbs(leaves, control):
        rows.append((names[i], [{"left": a.decode(), "right": z.decode()} for a, z in climb.steps()]))
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.table({"g": pa.array([r[0] for r in rows], pa.string()), "above": pa.array([r[1] for r in rows], kind)})


def _checks(_, leaves: pa.Table, control: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("row")
    digests, others = leaves.column("digest").to_pylist(), leaves.column("other").to_pylist()
    out: dict[str, list] = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")}
    for c, i, climb, siblings in climbs(leaves, control):
        steps = climb.steps()
        at = (others[i] or digests[i]).hex().encode()
        for left, right in steps:
            at = node(left + at + right)
        row = (digests[i].hex(), c["subroot"], c["root"], sha256(siblings).hexdigest(), at.decode(), at.decode() == c["root"], [{"left": a.decode(), "right": z.decode()} for a, z in steps] if c["with_proof"] else None)
        for column, x in zip(out.values(), row):
            column.append(x)
    kinds = [pa.string()] * 5 + [pa.bool_(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))]
    return pa.Table.from_arrays([leaves.column("id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=["id", *out])


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, changed: dict[str, Column] | None = None, where: Column | None = None, proofs: bool = False) -> DataFrame:
    """Per row: its id, leaf, the group's subroot, the root, proof_sha256 (of its siblings, from the leaf up), folded_root and verified.

    changed, where: other values of some fields that the rows of `where` are checked with, against the
    proofs of the original rows; without it each row is checked as it is. proofs: also the proof itself,
    level by level what stands left and right of the node: see `fold`.
    """
    field = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_digest(*field.values())
    other = F.when(where if where is not None else F.lit(True), leaf_digest(*({**field, **changed}[c] for c in fields))) if changed else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = stored(docs.select(group.alias("g"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("number")))
    each = max(1, LEAVES // 10) if proofs else LEAVES
    tree = build_tree(rows, ["id", "digest", "number"], each)
    groups = stored(tree.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"))
    upper = build_tree(groups, ["name"], each)
    root = upper.roots.first()
    above = upper.leaves.select("part", "row", "digest", "name").groupBy("part").cogroup(upper.control.groupBy("part")).applyInArrow(_group_paths, f"g string, above {STEPS}")
    top = stored(above.join(tree.roots.select("g", F.lower(F.hex("digest")).alias("subroot")), "g"))
    spans = tree.control.where("n IS NOT NULL").join(top, "g", "left")
    control = spans.unionByName(tree.control.where("n IS NULL"), allowMissingColumns=True).select("*", F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), F.lit(proofs).alias("with_proof"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof {STEPS}"
    found = tree.leaves.select("part", "row", "id", "digest", "other").groupBy("part").cogroup(control.groupBy("part")).applyInArrow(_checks, schema)
    return found.withColumnRenamed("id", id_col).drop(*[] if proofs else ["proof"])


def without_line_feeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, Column], Column]:
    """The tampering of the check: documents whose id, as decimal text, has an even CRC-32 lose the line feeds of their text."""
    even = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {text_col: F.replace(F.col(f"`{text_col}`"), F.lit("\n"), F.lit(""))}, even
