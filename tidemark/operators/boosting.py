"""Gradient boosting of the discrete-time hazard by histograms, as jobs over loans.

Loans are stored once as bin numbers: quantile bins of numbers, frequent levels of categories, and bin
0 for a missing value. A row of the stored table is a block of loans of about as many periods, a column
of it an array over the block. A task sums gradients per leaf, feature and bin over all its loans, and
sends these sums, whose size does not depend on the
number of loans. They meet by (leaf, feature), where the best split of that feature is found: a cut
with a learned side for missing values, or a set of levels, taken in the order of their gradients. Only
the best split of each leaf and feature reaches the driver, which grows the tree a level at a time,
the largest gains first where leaves run out. A split comes with the sums of its sides, so the last
level takes no pass.

All features but the period are the same in all periods of a loan. So a split on one of them is looked
up once a loan, one on the period not at all, and a loan's gradients are added over the periods of a
leaf before they are added by bins.

Margins are not recomputed from the first tree: every `STATE` trees they are written with the loans, so
the plan stays short and a lost executor costs one pass. The loss on training and validation loans
comes with the first pass of the next tree; fitting stops when the latter has not fallen for `patience`
trees, and keeps the trees up to the best.

Defined results: NaN counts as missing. Levels beyond the frequent ones, and levels that training
lacked, share one bin. A feature without a value has no split. Loans without events, or without loans
at risk, give a constant hazard.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import unpivoted
from tidemark.operators.ranks import quantiles
from tidemark.sources.shipping import ship
from tidemark.sources.store import LONG_ROWS, stored

#: Trees after which margins are written.
STATE = 8
#: Loans of a file of the stored state at most, about: a pass has a task a file, or a few.
STATE_ROWS = 100_000
#: Loans and margins of a block at most.
BLOCK, MARGINS = 4096, 65_536
#: Bytes of files that a task of a pass reads at most, about: a few files, so that cores end together.
READ = 40 << 20
#: Loans that are scored at once, about.
SCORED = 8192
#: Features of a leaf's path up to which its shares are looked up by which of them lead to the leaf.
LOOKED_UP = 12
#: Bins of a feature at most, that of missing values among them.
BINS = 255
EVENTS = 1e-9


@dataclass
class Bins:
    """Upper edges of the bins of each number, levels of each category; bin 0 is missing, a level's last bin holds all others."""

    edges: dict[str, np.ndarray]
    levels: dict[str, list[str]]

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.levels]

    def of(self, part: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(part), len(self.features)), np.int16)
        for j, c in enumerate(self.features):
            if c in self.edges:
                v = part[c].to_numpy(float, na_value=np.nan)
                out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(self.edges[c], v) + 1)
            else:
                at = {x: i for i, x in enumerate(self.levels[c], 1)}
                out[:, j] = [0 if pd.isna(x) else at.get(x, len(at) + 1) for x in part[c]]
        return out

    def of_batch(self, batch: pa.RecordBatch, prefix: str = "") -> np.ndarray:
        """The same of Arrow columns, a row a feature."""
        out = np.zeros((len(self.features), batch.num_rows), np.int16)
        for j, c in enumerate(self.features):
            column = batch.column(prefix + c)
            if c in self.edges:
                v = column.to_numpy(zero_copy_only=False)
                out[j] = np.where(np.isnan(v), 0, np.searchsorted(self.edges[c], v) + 1)
            else:
                at, coded = {x: i for i, x in enumerate(self.levels[c], 1)}, column.dictionary_encode()
                numbers = np.array([*(at.get(x, len(at) + 1) for x in coded.dictionary.to_pylist()), 0])
                out[j] = numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]
        return out

    def sizes(self, periods: int) -> np.ndarray:
        """Bins of each feature, and last of the period."""
        return np.array([*(len(e) + 2 for e in self.edges.values()), *(len(x) + 2 for x in self.levels.values()), periods + 1])


def fit_bins(df: DataFrame, numeric: list[str], categorical: list[str], most: int = BINS) -> Bins:
    """Quantile edges and the most frequent levels of all rows: `most` of a column at most."""
    values = unpivoted(df.select([F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in numeric]), numeric, "double") if numeric else None
    cuts = {r["column"]: r["q"] for r in quantiles(values, ["column"], "value", [i / (most - 2) for i in range(1, most - 2)] or [0.5]).collect()} if numeric else {}
    levels = {}
    for c in categorical:
        top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).count().orderBy(F.desc("count"), "level").limit(most - 2).collect()
        levels[c] = sorted(r.level for r in top)
    return Bins({c: np.unique(np.array(cuts.get(c, []), float)) for c in numeric}, levels)


@dataclass
class Tree:
    """Nodes in the order they were made, the root first; left < 0: a leaf. goes_left: by node and bin; cover: rows that trained it; gain: of the node's split."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def root(cls, width: int) -> Tree:
        one = lambda x, t: np.array([x], t)
        return cls(one(0, np.int32), np.zeros((1, width), bool), one(-1, np.int32), one(-1, np.int32), one(0, float), one(0, float), one(0, float))

    def split(self, node: int, feature: int, goes_left: np.ndarray, gain: float) -> None:
        n = len(self.left)
        self.feature[node], self.gain[node], self.left[node], self.right[node] = feature, gain, n, n + 1
        self.goes_left[node, : len(goes_left)] = goes_left
        for name in ("feature", "left", "right", "value", "cover", "gain"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(2, -1 if name in ("left", "right") else 0, old.dtype)]))
        self.goes_left = np.concatenate([self.goes_left, np.zeros((2, self.goes_left.shape[1]), bool)])

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int32)
        while True:
            go = np.flatnonzero(self.left[node] >= 0)
            if not len(go):
                return node
            at = node[go]
            node[go] = np.where(self.goes_left[at, bins[go, self.feature[at]]], self.left[at], self.right[at])

    def pieces(self, bins: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(which periods, as the bits of a number, and the value of each loan in them), each period once. bins: a row a feature; at: the bins of the periods."""

        def below(i: int, which: int) -> list:
            if self.left[i] < 0:
                return [(which, self.value[i])]
            f, children, way = self.feature[i], (self.left[i], self.right[i]), self.goes_left[i]
            if f == len(bins):
                left = sum(1 << k for k in np.flatnonzero(way[at]).tolist())
                return [piece for child, w in zip(children, (which & left, which & ~left)) if w for piece in below(child, w)]
            (a, *more), (b, *others) = (below(child, which) for child in children)
            if not more and not others and np.ndim(a[1]) == np.ndim(b[1]) == 0:  # both are leaves
                return [(which, np.where(way, a[1], b[1]).take(bins[f]))]
            way = way.take(bins[f])
            return [(w & v, np.where(way, x, y)) for w, x in (a, *more) for v, y in (b, *others) if w & v]

        return below(0, (1 << len(at)) - 1)

    def add_to(self, margins: np.ndarray, bins: np.ndarray, at: np.ndarray) -> None:
        """margins: a row a period, a column a loan."""
        for which, value in self.pieces(bins, at):
            if which == (1 << len(at)) - 1:
                margins += value
            else:
                for k in range(len(at)):
                    if which >> k & 1:
                        margins[k] += value

    def reached(self, nodes: list[int], bins: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which periods, by loan the place in `nodes` of the one that it reaches in them, or -1): nodes of the same periods together, as no two of them hold a loan."""
        above = {int(child): i for i in np.flatnonzero(self.left >= 0) for child in (self.left[i], self.right[i])}

        def way(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in found:
                loans, which = way(above[i])
                f, side = self.feature[above[i]], self.goes_left[above[i]] == (self.left[above[i]] == i)
                found[i] = (loans, which & side[at]) if f == len(bins) else (loans & side.take(bins[f]), which)
            return found[i]

        found, groups = {0: (np.ones(bins.shape[1], bool), np.ones(len(at), bool))}, {}
        for k, i in enumerate(nodes):
            loans, which = way(i)
            if which.any():
                groups.setdefault(which.tobytes(), (which, np.full(bins.shape[1], -1)))[1][loans] = k
        return list(groups.values())

    def leaves(self) -> list[tuple[float, dict[int, tuple[np.ndarray, float]]]]:
        """(value, by feature of its path: the bins that reach it, the share of training rows that the conditions let through)."""
        out, todo = [], [(0, {})]
        while todo:
            i, path = todo.pop()
            if self.left[i] < 0:
                out.append((float(self.value[i]), path))
                continue
            f = int(self.feature[i])
            mask, share = path.get(f, (np.ones(self.goes_left.shape[1], bool), 1.0))
            for child, way in ((self.left[i], self.goes_left[i]), (self.right[i], ~self.goes_left[i])):
                todo.append((int(child), {**path, f: (mask & way, share * self.cover[child] / self.cover[i])}))
        return out


def bagged(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which loans a tree trains on, by a hash of the loan and the tree."""
    h = key.view(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(a))) * np.uint64(m)
    return (h >> np.uint64(11)).astype(float) / 2**53 < share


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, levels: bool, least: float, l2: float, smooth: float) -> tuple[float, np.ndarray] | None:
    """(gain, bins that go left) of one leaf and feature, or None. Ties: the smallest left side, then missing values on the right."""
    G, H, N = g.sum(), h.sum(), n.sum()
    if levels:
        there = np.flatnonzero(n > 0)
        order = there[np.argsort(g[there] / (h[there] + smooth), kind="stable")]
        sides = [(order, False)]
    else:
        sides = [(np.arange(1, len(g)), missing) for missing in ([False, True] if n[0] else [False])]
    found = None
    for order, missing in sides:
        start = (g[0], h[0], n[0]) if missing else (0.0, 0.0, 0.0)
        gl, hl, nl = (s + np.cumsum(x[order])[:-1] for s, x in zip(start, (g, h, n)))
        if not levels and not missing and n[0]:  # all values against the missing ones
            gl, hl, nl = (np.append(x, t[1:].sum()) for x, t in zip((gl, hl, nl), (g, h, n)))
        ok = (nl >= least) & (N - nl >= least) & (hl > 1e-3) & (H - hl > 1e-3)
        if not ok.any():
            continue
        gain = np.where(ok, gl**2 / (np.where(ok, hl, 1) + l2) + (G - gl) ** 2 / (np.where(ok, H - hl, 1) + l2) - G**2 / (H + l2), -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 1e-9 and (found is None or gain[at] > found[0]):
            left = np.zeros(len(g), bool)
            left[order[: at + 1]] = True
            left[0] |= missing
            if not levels and not n[0]:
                left[0] = nl[at] >= N - nl[at]  # no missing value seen: they go with the larger side
            found = float(gain[at]), left
    return found


def _share(j: int, path: dict, on: dict) -> np.ndarray:
    """Feature j's share of a leaf's value: the sum over subsets of the path's other features. on: by feature, whether the row's bin goes on to the leaf."""
    d = len(path)
    ways = np.zeros((d, len(on[j])))  # by how many of the other features are in: the product over all of them
    ways[0] = 1
    for f in path:
        if f != j:
            ways[1:], ways[0] = ways[1:] * path[f][1] + ways[:-1] * on[f], ways[0] * path[f][1]
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    return (weight @ ways) * (on[j] - path[j][1])


@dataclass
class Booster:
    bins: Bins
    months: int
    periods: int
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: (trees, training loss, validation loss or None), the constant first.
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.bins.features, "period"]

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.leaf_of(bins)] for t in self.trees), np.zeros(len(bins)))

    def hazard(self, bins: np.ndarray) -> np.ndarray:
        return np.clip(1 / (1 + np.exp(-self.margin(bins))), EVENTS, 1 - EVENTS)

    def hazards_of(self, bins: np.ndarray, periods: int) -> np.ndarray:
        """(periods, loans). bins: a row a feature; periods beyond training count as its last."""
        at = np.minimum(np.arange(1, periods + 1), self.periods)
        margins = np.full((periods, bins.shape[1]), self.base)
        bins = bins.astype(np.intp)
        for t in self.trees:
            t.add_to(margins, bins, at)
        return np.clip(1 / (1 + np.exp(-margins)), EVENTS, 1 - EVENTS)

    def log_survival(self, bins: np.ndarray, periods: int) -> np.ndarray:
        """(rows, periods): of the logarithm of survival up to each period's end. bins: a row a loan."""
        return np.cumsum(np.log1p(-self.hazards_of(bins.T, periods)), axis=0).T

    def survival(self, times: list[int]):
        """A numpy function (matrix of the numbers, NaN for missing) -> (rows, times), for models without categories."""
        ends = [max(0, -(-t // self.months)) for t in times]

        def predict(x: np.ndarray) -> np.ndarray:
            s = np.exp(self.log_survival(self.bins.of(pd.DataFrame(x, columns=self.bins.features)), max(ends, default=0) or 1))
            return np.column_stack([s[:, e - 1] if e else np.ones(len(x)) for e in ends])

        return predict

    def _scored(self, df: DataFrame, keep: list[str], made: str, score) -> DataFrame:
        """(keep..., the columns `made`). score: (bins, a row a feature) -> tables of (the loan of each row, its columns)."""
        ship(df.sparkSession)
        names = [*keep, *(c.split()[0] for c in made.split(", "))]

        def rows(batches):
            for batch in _together(batches):
                for loan, *columns in score(self.bins.of_batch(batch)):
                    kept = batch.select([f"_k{i}" for i in range(len(keep))]) if keep else batch.select([])
                    yield pa.RecordBatch.from_arrays([*(kept if loan is None else kept.take(pa.array(loan))).columns, *columns], names=names)

        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
        return self._inputs(df, keep).mapInArrow(rows, kinds + made)

    def hazards(self, df: DataFrame, periods: int, keep: list[str]) -> DataFrame:
        """(keep..., period, hazard) for each row and period up to `periods`."""

        def score(bins):
            n = bins.shape[1]
            yield np.repeat(np.arange(n), periods), pa.array(np.tile(np.arange(1, periods + 1, dtype=np.int32), n)), pa.array(self.hazards_of(bins, periods).T.ravel())

        return self._scored(df, keep, "period int, hazard double", score)

    def survived(self, df: DataFrame, periods: int, keep: list[str]) -> DataFrame:
        """(keep..., survival) after `periods`, a row each."""
        return self._scored(df, keep, "survival double", lambda bins: [(None, pa.array(np.exp(np.log1p(-self.hazards_of(bins, periods)).sum(axis=0))))])

    def ablated(self, df: DataFrame, groups: dict[str, list[str]], periods: int, keep: list[str]) -> DataFrame:
        """(keep..., dropped, risk): 1 - survival after `periods` with each group's features missing, as a file without these columns has them; one scoring pass over all groups."""
        gone = {name: [self.bins.features.index(f) for f in own if f in self.bins.features] for name, own in groups.items()}

        def score(bins):
            for name, own in gone.items():
                some = bins.copy()
                some[own] = 0
                risk = 1 - np.exp(np.log1p(-self.hazards_of(some, periods)).sum(axis=0))
                yield None, pa.array([name]).take(pa.array(np.zeros(len(risk), np.int32))), pa.array(risk)

        return self._scored(df, keep, "dropped string, risk double", score)

    def _inputs(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *[F.col(c).cast("double").alias(c) for c in self.bins.edges], *[F.col(c).cast("string").alias(c) for c in self.bins.levels])

    def importance(self) -> list[tuple[str, float, int]]:
        """(feature, gain, splits), largest gain first; features without a split too."""
        gain, splits = np.zeros(len(self.features)), np.zeros(len(self.features), int)
        for t in self.trees:
            inner = t.left >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
            np.add.at(splits, t.feature[inner], 1)
        return sorted(zip(self.features, gain.tolist(), splits.tolist()), key=lambda r: (-r[1], r[0]))

    def shapley(self, bins: np.ndarray) -> np.ndarray:
        """(rows, features) of the margin, path-dependent: a feature that is left out follows a path by the share of training rows. Exact: the sum over subsets of a path's features is a polynomial."""
        out = np.zeros(bins.shape)
        for tree in self.trees:
            for value, path in tree.leaves():
                on = {f: mask[bins[:, f]].astype(float) for f, (mask, _) in path.items()}
                for j in path:
                    out[:, j] += value * _share(j, path, on)
        return out

    def shares(self) -> list[list[tuple]]:
        """By tree and leaf: (value, the bins of each feature of a loan that lead to it, periods that do or None, by whether the period does the share of each feature by which of them do)."""
        last = len(self.bins.features)

        def of(path: dict) -> dict | None:
            fs = [f for f in path if f != last]
            if len(fs) > LOOKED_UP:
                return None
            on = {f: (np.arange(1 << len(fs)) >> k & 1).astype(float) for k, f in enumerate(fs)}
            return {let: [_share(j, path, on | {last: float(let)}) for j in fs] for let in (False, True)}

        return [[(value, path, path[last][0] if last in path else None, of(path)) for value, path in tree.leaves()] for tree in self.trees]

    def hazard_shapley(self, bins: np.ndarray, periods: int, shares: list | None = None) -> np.ndarray:
        """(loans, their features): minus the sum over periods of the hazard times `shapley` at the loan and period. A leaf's part depends on the period only by whether it lets the period through: it is found once for each of the two, with the hazards of these periods summed. shares: those of this model, if made already."""
        hazard, columns = self.hazards_of(bins.T, periods), bins.T.astype(np.intp)
        at, last = np.minimum(np.arange(1, periods + 1), self.periods), len(self.bins.features)
        out, summed = np.zeros(columns.shape), {}
        for value, path, through, by_way in (leaf for tree in (self.shares() if shares is None else shares) for leaf in tree):
            fs = [f for f in path if f != last]
            through = np.ones(periods, bool) if through is None else through[at]
            if by_way:
                way = np.zeros(columns.shape[1], np.intp)
                for k, f in enumerate(fs):
                    way |= (path[f][0].astype(np.intp) << k).take(columns[f])
            else:
                on = {f: path[f][0].take(columns[f]).astype(float) for f in fs}
            for let in np.unique(through):
                which = through == let
                if which.tobytes() not in summed:
                    summed[which.tobytes()] = hazard[which].sum(axis=0)
                weight = value * summed[which.tobytes()]
                for k, j in enumerate(fs):
                    out[j] -= weight * (by_way[bool(let)][k].take(way) if by_way else _share(j, path, on | {last: float(let)}))
        return out.T

    def tree_shap(self, df: DataFrame, periods: int, keep: list[str]) -> DataFrame:
        """(keep..., feature, phi): minus the sum over periods of the row's own hazard times its margin's attribution; the period itself is no feature of a loan."""
        names, shares = self.bins.features, self.shares()

        def score(bins):
            n, phi = bins.shape[1], self.hazard_shapley(bins.T, periods, shares)
            yield np.repeat(np.arange(n), len(names)), pa.array(names).take(pa.array(np.tile(np.arange(len(names)), n))), pa.array(np.ascontiguousarray(phi).ravel())

        return self._scored(df, keep, "feature string, phi double", score)


def _together(batches, rows: int = SCORED):
    """The batches of a task, some of them as one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_BLOCK = "train boolean, key binary, n binary, event binary, weight binary, bins binary, margins binary"


def _block(batch: pa.RecordBatch, i: int) -> tuple:
    """(train, key, n, event, weight, bins: a row a feature, margins: a row a period) of a stored row."""
    get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    n = get("n", np.int32)
    return batch.column("train")[i].as_py(), get("key", np.int64), n, get("event", np.int8), get("weight", float), get("bins", np.int16).reshape(-1, len(n)), get("margins", float).reshape(-1, len(n))


def _kept(state: DataFrame) -> DataFrame:
    """Stored blocks as `fit_boosting` keeps them in the executors' memory, or on their disks, while passes read them; what is lost is read again."""
    return state.select("*", F.lit(True).alias("kept"))


@contextmanager
def _reading(spark, size: int):
    """Tasks read files of about `size` bytes in all meanwhile."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _as_blocks(bins: Bins, last: int, base: float):
    """A function for tasks: loans -> blocks of loans of about as many periods, with the constant as their margin."""

    def made(batches):
        batches = list(batches)  # STATE_ROWS loans, about
        if not sum(b.num_rows for b in batches):
            return
        loans = pa.concat_batches(batches)
        get = lambda name: loans.column(name).to_numpy(zero_copy_only=False)
        x, n = bins.of_batch(loans, "x_"), np.minimum(get("n"), last).astype(np.int32)
        event = np.where(get("n") > last, 0, get("event")).astype(np.int8)  # validation beyond the last trained period
        key, weight, train = get("key"), get("weight"), bool(loans.column("train")[0].as_py())
        order, size = np.argsort(n, kind="stable"), max(1, min(BLOCK, MARGINS // last))
        for a in range(0, len(order), size):
            own = order[a : a + size]
            columns = [key[own], n[own], event[own], weight[own], x[:, own], np.full((int(n[own].max()), len(own)), base)]
            yield pa.RecordBatch.from_arrays([pa.array([train]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=[c.split()[0] for c in _BLOCK.split(", ")])

    return made


def _pass(state: DataFrame, trees: list[Tree], first: int, growing: Tree, nodes: list[int], sizes: np.ndarray, features: list[int], bagging: float, levels: int, split: dict, valid: DataFrame | None = None) -> tuple[list, dict[int, tuple], dict[bool, tuple]]:
    """One job: the best split of each node and feature, with the (gradient, hessian, rows) of its left side; with the root also its own such sums, and the losses by training or not.

    trees: those since margins were written; first: the number of the growing tree; levels: where features with levels begin, the period excepted; valid: blocks that only the losses need.
    """
    width, with_loss = int(sizes.max()), nodes == [0]

    def sums(batches):
        total, losses = np.zeros((3, len(features), len(nodes), width)), np.zeros((2, 2))
        for train, key, n, event, weight, bins, margins in (_block(batch, i) for batch in batches for i in range(batch.num_rows)):
            used = bagged(key, first, bagging) if train and bagging < 1 else np.full(len(n), train)
            if not with_loss and not used.all():
                own = np.flatnonzero(used)
                n, event, weight, bins, margins, used = n[own], event[own], weight[own], bins.take(own, axis=1), margins.take(own, axis=1), used[own]
            bins, margins, at = bins.astype(np.intp), margins.copy() if margins.base is not None else margins, np.arange(1, len(margins) + 1)
            for t in trees:
                t.add_to(margins, bins, at)
            seen = at[:, None] <= n if len(n) and n.min() < len(at) else None
            had = np.flatnonzero(event == 1)
            odds = np.exp(np.negative(margins))
            odds += 1  # 1 / p
            if with_loss:
                margins += np.log(odds)  # of 1 / (1 - p)
                losses[int(train)] += weight @ (margins if seen is None else margins * seen).sum(axis=0) - weight[had] @ (margins[n[had] - 1, had] - np.log(odds[n[had] - 1, had])), weight @ n
            if not used.any():
                continue
            g = np.reciprocal(odds, out=odds)
            h = np.subtract(1, g, out=margins)
            h *= g
            g[n[had] - 1, had] -= 1
            for x in (g, h):
                if seen is not None:
                    x *= seen
                if (weight != 1).any():
                    x *= weight
            for which, slot in growing.reached(nodes, bins, at):
                rows = at[which]
                own = (g, h) if which.all() else (g[which], h[which])
                inside = (slot >= 0) & used
                if inside.mean() > 0.7:  # what is outside adds zeros
                    use, place, inside = slice(None), np.where(inside, slot, 0) * width, inside.astype(float)
                else:
                    use = np.flatnonzero(inside)
                    place, inside = slot[use] * width, np.ones(len(use))
                own, left, some = [x[:, use] for x in own], n[use], bins[:, use]
                there = np.ones((len(rows), 1)) if seen is None else (rows[:, None] <= left).astype(float)
                added = [x.sum(axis=0) * inside for x in (*own, np.broadcast_to(there, own[0].shape))]
                for i, f in enumerate(features):
                    if f < len(bins):
                        at_bins = place + some[f]
                        for k, x in enumerate(added):
                            total[k, i] += np.bincount(at_bins, x, minlength=len(nodes) * width).reshape(len(nodes), width)
                    else:
                        of = (place == np.arange(len(nodes))[:, None] * width) * inside
                        for k, x in enumerate((*own, np.broadcast_to(there, own[0].shape))):
                            total[k, i][:, rows] += of @ x.T
        made = [(nodes[a], f, *total[:, i, a, : sizes[f]]) for a in range(len(nodes)) for i, f in enumerate(features) if total[2, i, a].any()]
        made += [(-1, k, losses[k], np.zeros(0), np.zeros(0)) for k in (0, 1)] if with_loss else []
        lists = [pa.ListArray.from_arrays(np.cumsum([0, *(len(r[k]) for r in made)], dtype=np.int32), np.concatenate([np.zeros(0), *(r[k] for r in made)])) for k in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in made], pa.int32()) for k in (0, 1)], *lists], names=["node", "feature", "g", "h", "n"])

    def best(key, table):
        node, feature = key[0].as_py(), key[1].as_py()
        g, h, n = (table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0) for c in ("g", "h", "n"))
        if node < 0:
            rows = [(node, feature, float(g[0]), [float(g[1])])]
        else:
            found = best_split(g, h, n, feature >= levels and feature < len(sizes) - 1, **split)
            rows = [(node, feature, found[0], [*(float(x[found[1]].sum()) for x in (g, h, n)), *found[1].astype(float).tolist()])] if found else []
            if with_loss and feature == features[0]:
                rows.append((node, -1, float(g.sum()), [float(h.sum()), float(n.sum())]))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["node", "feature", "value", "more"])

    with _reading(state.sparkSession, READ):
        found = reduce(DataFrame.unionByName, [_kept(s) for s in (state, valid) if s is not None]).mapInArrow(sums, "node int, feature int, g array<double>, h array<double>, n array<double>").groupBy("node", "feature").applyInArrow(best, "node int, feature int, value double, more array<double>").collect()
    splits = [(r.node, r.feature, r.value, np.array(r.more[3:]) > 0, tuple(r.more[:3])) for r in found if r.node >= 0 and r.feature >= 0]
    return splits, {r.node: (r.value, *r.more) for r in found if r.node >= 0 and r.feature < 0}, {bool(r.feature): (r.value, r.more[0]) for r in found if r.node < 0}


def fit_boosting(df: DataFrame, numeric: list[str], categorical: list[str] = [], *, valid: DataFrame | None = None, id_col: str = "id", weight: str | None = None, months: int = 1, horizon: int | None = 60, trees: int = 400, leaves: int = 63, depth: int = 6, rate: float = 0.05, least: int = 200, l2: float = 0.0, smooth: float = 10.0, bagging: float = 0.8, features_share: float = 0.8, patience: int = 50, bins: int = BINS, seed: int = 20260921) -> Booster:  # noqa: B006
    """P(event in this period | alive before it), boosted on loans with duration_months, event and the features.

    valid: loans whose loss ends the fit once it has not fallen for `patience` trees. weight: a column of
    loan weights. bagging: the share of loans, features_share: of features, that each tree sees.
    """
    ship(df.sparkSession)
    model = Booster(fit_bins(df, numeric, categorical, bins), months, 1, 0.0)
    d = F.col("duration_months").cast("double")
    cut = F.least(d, F.lit(float(horizon))) if horizon else d
    columns = [F.xxhash64(id_col).alias("key"), F.greatest(F.ceil(cut / months), F.lit(1)).cast("int").alias("n"), (F.when(d > horizon, 0).otherwise(F.col("event")) if horizon else F.col("event")).cast("int").alias("event")]

    def side(frame: DataFrame, train: bool) -> DataFrame:
        w = F.col(weight).cast("double") if weight and train else F.lit(1.0)
        inputs = [F.col(c).cast("double").alias(f"x_{c}") for c in numeric] + [F.col(c).cast("string").alias(f"x_{c}") for c in categorical]
        return frame.select(*columns, w.alias("weight"), F.lit(train).alias("train"), *inputs)

    sides = [side(df, True)] + ([side(valid, False)] if valid is not None else [])
    loans = reduce(DataFrame.unionByName, sides)
    totals = loans.agg(F.max(F.when(F.col("train"), F.col("n"))), *[F.sum(F.when(F.col("train"), F.col("weight") * x)) for x in (F.col("event"), F.col("n"))], F.count_if("train"), F.count_if(~F.col("train"))).first()
    model.periods = totals[0] or 1
    share = min(max((totals[1] or 0) / (totals[2] or 1), EVENTS), 1 - EVENTS)
    model.base = float(np.log(share / (1 - share)))
    sizes = model.bins.sizes(model.periods)
    to_blocks = _as_blocks(model.bins, model.periods, model.base)
    state = [stored(frame.repartition(max(1, -(-n // STATE_ROWS))).mapInArrow(to_blocks, _BLOCK), LONG_ROWS) for frame, n in zip(sides, totals[3:])]
    kept = [_kept(s).persist() for s in state]
    since: list[Tree] = []
    rng = np.random.default_rng(seed)
    split = {"least": least, "l2": l2, "smooth": smooth}
    best = None
    while True:
        number, tree = len(model.trees), Tree.root(int(sizes.max()))
        chosen = sorted(rng.choice(len(sizes), max(1, round(features_share * len(sizes))), replace=False).tolist()) if features_share < 1 else list(range(len(sizes)))
        nodes, level, sums = [0], 0, {}
        while nodes:
            splits, root, losses = _pass(state[0], since, number, tree, nodes, sizes, chosen, bagging, len(model.bins.edges), split, *([] if level else state[1:]))
            if not level:
                mean = {k: v[0] / v[1] for k, v in losses.items() if v[1]}
                model.history.append((number, mean.get(True, 0.0), mean.get(False)))
                now = mean.get(False)
                if now is not None and (best is None or now < model.history[best][2] - 1e-12):
                    best = number
                if number >= trees or (best is not None and number - best >= patience):
                    break
            for i, (g, h, n) in root.items():
                sums[i], tree.value[i], tree.cover[i] = (g, h, n), -g / (h + l2) * rate if h + l2 > 0 else 0.0, n
            wanted: dict[int, tuple] = {}
            for i, f, gain, left, part in sorted(splits, key=lambda s: (s[0], -s[2], s[1])):
                wanted.setdefault(i, (gain, f, left, part))
            room = leaves - int((tree.left < 0).sum()) if level < depth else 0
            nodes = []
            for i in sorted(wanted, key=lambda i: (-wanted[i][0], i))[:room]:
                gain, f, left, part = wanted[i]
                tree.split(i, f, left, gain)
                for child, (g, h, n) in zip((tree.left[i], tree.right[i]), (part, tuple(x - y for x, y in zip(sums[i], part)))):
                    sums[int(child)], tree.value[child], tree.cover[child] = (g, h, n), -g / (h + l2) * rate if h + l2 > 0 else 0.0, n
                    nodes.append(int(child))
            level += 1
            nodes = [i for i in nodes if sums[i][2] >= 2 * least] if level < depth and (tree.left < 0).sum() < leaves else []  # those that can be split
        else:
            if tree.left[0] < 0:  # no split gains anything
                break
            model.trees.append(tree)
            since.append(tree)
            if len(since) == STATE:
                state, since = [stored(_with_margins(s, since), LONG_ROWS) for s in kept], []
                for old in kept:
                    old.unpersist()
                kept = [_kept(s).persist() for s in state]
            continue
        break
    for old in kept:
        old.unpersist()
    if best is not None:
        model.trees = model.trees[:best]
    return model


def _with_margins(state: DataFrame, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' values added to their margins."""

    def add(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                *_, bins, margins = _block(batch, i)
                bins, margins = bins.astype(np.intp), margins.copy()
                for t in trees:
                    t.add_to(margins, bins, np.arange(1, len(margins) + 1))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:-1]], pa.array([margins.tobytes()], pa.binary())], names=batch.schema.names)

    return state.drop("kept").mapInArrow(add, _BLOCK)
