"""Hazard trees against a plain version that loops over exploded rows."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import boosting

NUMBERS, KINDS = ["a", "b", "gap"], ["kind"]


def loans_of(n, seed, signal=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = rng.normal(), float(rng.integers(0, 4))
        gap = None if rng.random() < 0.3 else float(rng.normal())
        kind = [None, "x", "y", "z", "rare"][rng.choice(5, p=[0.1, 0.3, 0.3, 0.28, 0.02])]
        chance = 1 / (1 + np.exp(3 - signal * (a + (1.5 if gap is None else 0.0) + (1.0 if kind in ("y", None) else 0.0))))
        life = int(rng.geometric(chance)) if chance > 0 else 99
        seen = int(rng.integers(1, 15))
        out.append((i, float(np.round(a, 2)), b, gap, kind, min(life, seen), int(life <= seen), float(rng.integers(1, 4))))
    return out


SCHEMA = "id long, a double, b double, gap double, kind string, duration_months int, event int, w double"


def plain_fit(rows, valid, bins, *, horizon, trees, leaves, depth, rate, least, l2, smooth, patience):
    """Trees as nested tuples, and the losses; rows: loans with bins, n, event, weight."""

    def exploded(loans):
        x, y, w = [], [], []
        for b, n, e, weight in loans:
            for k in range(1, n + 1):
                x.append([*b, k])
                y.append(int(e and k == n))
                w.append(weight)
        return np.array(x), np.array(y, float), np.array(w, float)

    def losses(m, y, w):
        return float((w * (np.log1p(np.exp(m)) - y * m)).sum() / w.sum())

    (x, y, w), (vx, vy, vw) = exploded(rows), exploded(valid)
    base = np.log((w * y).sum() / ((w * (1 - y)).sum()))
    m, vm = np.full(len(y), base), np.full(len(vy), base)
    width = [len(e) + 2 for e in bins.edges.values()] + [len(v) + 2 for v in bins.levels.values()] + [int(x[:, -1].max()) + 1]
    n_numbers, gains, history, best = len(bins.edges), np.zeros(len(width)), [], None
    for t in range(trees + 1):
        history.append((losses(m, y, w), losses(vm, vy, vw)))
        if best is None or history[-1][1] < history[best][1] - 1e-12:
            best = t
        if t == trees or t - best >= patience:
            break
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        leaf, vleaf = np.zeros(len(y), int), np.zeros(len(vy), int)
        open_, made, split = [0], 1, []
        for _ in range(depth):
            found = []
            for node in open_:
                own, best_of = leaf == node, None
                G, H = g[own].sum(), h[own].sum()
                for f in range(len(width)):
                    bag = [(g[own & (x[:, f] == v)].sum(), h[own & (x[:, f] == v)].sum(), int((own & (x[:, f] == v)).sum())) for v in range(width[f])]
                    if n_numbers <= f < len(width) - 1:
                        order = sorted((v for v in range(width[f]) if bag[v][2]), key=lambda v: bag[v][0] / (bag[v][1] + smooth))
                        sides = [set(order[: i + 1]) for i in range(len(order) - 1)]
                    else:
                        sides = [set(range(1, c + 1)) for c in range(1, width[f] - (0 if bag[0][2] else 1))]
                        sides += [s | {0} for s in sides[: width[f] - 2]] if bag[0][2] else []
                    for left in sides:
                        gl, hl, nl = (sum(bag[v][k] for v in left) for k in range(3))
                        n = int(own.sum())
                        if nl < least or n - nl < least or hl <= 1e-3 or H - hl <= 1e-3:
                            continue
                        gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                        if gain > 1e-9 and (best_of is None or gain > best_of[0] + 1e-12):
                            best_of = (gain, f, left, n, nl)
                if best_of:
                    found.append((node, best_of))
            room, open_ = leaves - (made - len(split)), []
            for node, (gain, f, left, _, _) in sorted(found, key=lambda r: -r[1][0])[:room]:
                gains[f] += gain
                for l_, xs in ((leaf, x), (vleaf, vx)):
                    inside, on_left = l_ == node, np.isin(xs[:, f], list(left))
                    l_[inside & on_left], l_[inside & ~on_left] = made, made + 1
                split.append(node)
                open_ += [made, made + 1]
                made += 2
        for node in set(range(made)) - set(split):
            own = leaf == node
            value = -g[own].sum() / (h[own].sum() + l2) * rate
            m[own] += value
            vm[vleaf == node] += value
    return history, best, gains


@pytest.mark.parametrize("leaves, depth", [(31, 3), (4, 3)])
def test_trees_equal_a_plain_version(spark, leaves, depth):
    rows, held = loans_of(260, 1), loans_of(90, 2)
    train, valid = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(held, SCHEMA).repartition(2)
    how = {"horizon": 10, "trees": 12, "leaves": leaves, "depth": depth, "rate": 0.3, "least": 15, "l2": 0.5, "smooth": 10.0, "patience": 3}
    model = boosting.fit_boosting(train, NUMBERS, KINDS, valid=valid, weight="w", bagging=1.0, features_share=1.0, bins=12, **how)
    frame = lambda r: pd.DataFrame(r, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    cut = lambda r, weight: [(b, min(x[5], 10), x[6] if x[5] <= 10 else 0, x[7] if weight else 1.0) for b, x in zip(model.bins.of(frame(r)).tolist(), r)]
    history, best, gains = plain_fit(cut(rows, True), cut(held, False), model.bins, **how)
    assert np.allclose([h[1:] for h in model.history], history, rtol=1e-9)
    assert len(model.trees) == best
    if best == len(history) - 1:
        assert np.allclose([dict((f, g) for f, g, _ in model.importance())[f] for f in model.features], gains)
    loss = [h[1] for h in model.history]
    assert loss == sorted(loss, reverse=True) and loss[-1] < loss[0] - 0.01


def test_fit_stops_by_itself_without_signal(spark):
    train, valid = (spark.createDataFrame(loans_of(n, s, signal=0.0), SCHEMA) for n, s in ((300, 3), (200, 4)))
    model = boosting.fit_boosting(train, NUMBERS, KINDS, valid=valid, horizon=12, trees=60, rate=0.3, least=5, depth=4, patience=3)
    assert len(model.history) < 30 and len(model.trees) == min(range(len(model.history)), key=lambda i: model.history[i][2])


def test_margins_written_after_some_trees_change_nothing(spark, monkeypatch):
    train = spark.createDataFrame(loans_of(200, 5), SCHEMA).repartition(3)
    how = {"horizon": 12, "trees": 6, "rate": 0.3, "least": 5, "depth": 2, "months": 3}
    one = boosting.fit_boosting(train, NUMBERS, KINDS, **how)
    monkeypatch.setattr(boosting, "STATE", 2)
    two = boosting.fit_boosting(train, NUMBERS, KINDS, **how)
    assert np.allclose([h[1] for h in one.history], [h[1] for h in two.history]) and len(one.trees) == 6


def test_predictions_follow_trees_and_missing_values(spark):
    rows = loans_of(400, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    model = boosting.fit_boosting(df, NUMBERS, KINDS, horizon=12, months=3, trees=8, rate=0.5, least=5, depth=3)
    new = [(1000, None, None, None, "unseen", 1, 0, 1.0), (1001, 0.0, 1.0, float("nan"), None, 1, 0, 1.0), *rows[:20]]
    got = model.hazards(spark.createDataFrame(new, SCHEMA), 6, ["id"]).collect()
    bins = model.bins.of(pd.DataFrame(new, columns=[c.split()[0] for c in SCHEMA.split(", ")]))
    for r in got:
        at = [i for i, x in enumerate(new) if x[0] == r.id][0]
        margin, row = model.base, [*bins[at], min(r.period, model.periods)]
        for t in model.trees:
            node = 0
            while t.left[node] >= 0:
                node = t.left[node] if t.goes_left[node, row[t.feature[node]]] else t.right[node]
            margin += t.value[node]
        assert abs(r.hazard - 1 / (1 + np.exp(-margin))) < 1e-12
    assert len(got) == 6 * len(new)
    gaps, full = (np.mean([h.hazard for h in got if (x := next(r for r in new if r[0] == h.id))[3] is None and x[0] < 1000]), np.mean([h.hazard for h in got if next(r for r in new if r[0] == h.id)[3] is not None]))
    assert gaps > full  # the missing values carry the signal


def test_attributions_equal_their_definition(spark):
    rows = loans_of(300, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    model = boosting.fit_boosting(df, NUMBERS, KINDS, horizon=12, months=3, trees=4, rate=0.5, least=5, depth=3, bagging=1.0)
    bins = model.bins.of(pd.DataFrame(rows[:6], columns=[c.split()[0] for c in SCHEMA.split(", ")]))
    full = np.column_stack([bins, np.full(6, 2)])

    def value(i, s):
        """The margin where only the features of s are known: others follow paths by the training rows' shares."""

        def walk(t, node):
            if t.left[node] < 0:
                return t.value[node]
            f = t.feature[node]
            if f in s:
                return walk(t, t.left[node] if t.goes_left[node, full[i, f]] else t.right[node])
            return sum(t.cover[c] / t.cover[node] * walk(t, c) for c in (t.left[node], t.right[node]))

        return sum(walk(t, 0) for t in model.trees)

    phi, p = model.shapley(full), full.shape[1]
    for i in range(6):
        for j in range(p):
            others = [f for f in range(p) if f != j]
            want = sum(factorial(k) * factorial(p - k - 1) / factorial(p) * (value(i, {*s, j}) - value(i, set(s))) for k in range(p) for s in combinations(others, k))
            assert abs(phi[i, j] - want) < 1e-9
    got = {(r.id, r.feature): r.phi for r in model.tree_shap(df.where("id < 6"), 2, ["id"]).collect()}
    want = sum(-model.hazard(x)[:, None] * model.shapley(x)[:, :-1] for x in (np.column_stack([bins, np.full(6, k)]) for k in (1, 2)))
    assert all(abs(got[i, f] - want[i, j]) < 1e-9 for i in range(6) for j, f in enumerate(model.bins.features))


def test_degenerate_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert boosting.fit_boosting(none, NUMBERS, KINDS).trees == []
    calm = spark.createDataFrame([(i, 1.0, 1.0, None, None, 5, 0, 1.0) for i in range(30)], SCHEMA)
    model = boosting.fit_boosting(calm, NUMBERS, KINDS, least=1)
    assert model.trees == [] and all(r.hazard < 1e-6 for r in model.hazards(calm, 2, ["id"]).collect())


def test_ablation_sets_columns_missing(spark):
    rows = loans_of(300, 8)
    model = boosting.fit_boosting(spark.createDataFrame(rows, SCHEMA), NUMBERS, KINDS, horizon=12, months=3, trees=5, rate=0.5, least=5, depth=3)
    new = spark.createDataFrame(rows[:20], SCHEMA)
    got = {(r.id, r.dropped): r.risk for r in model.ablated(new, {"none": [], "a and kind": ["a", "kind", "no such column"]}, 2, ["id"]).collect()}
    gone = spark.createDataFrame([(r[0], None, r[2], r[3], None, *r[5:]) for r in rows[:20]], SCHEMA)
    for name, df in (("none", new), ("a and kind", gone)):
        alive = {}
        for r in model.hazards(df, 2, ["id"]).collect():
            alive[r.id] = alive.get(r.id, 1.0) * (1 - r.hazard)
        assert all(abs(got[i, name] - (1 - s)) < 1e-12 for i, s in alive.items())
    assert len(got) == 40


def test_attributions_over_periods_are_found_once_a_leaf(spark):
    """hazard_shapley against its sum a period, on trees that split on the period too and beyond the last trained one."""
    df = spark.createDataFrame(loans_of(400, 7, 2.0), SCHEMA)
    model = boosting.fit_boosting(df, NUMBERS, KINDS, months=2, horizon=12, trees=6, leaves=8, depth=4, rate=0.3, least=5, bagging=1.0, features_share=1.0)
    last = len(model.bins.features)
    assert any((t.feature[t.left >= 0] == last).any() for t in model.trees)
    bins = model.bins.of(df.limit(50).toPandas())
    periods = model.periods + 2
    want = sum(-model.hazard(x)[:, None] * model.shapley(x)[:, :-1] for x in (np.column_stack([bins, np.full(len(bins), min(k, model.periods))]) for k in range(1, periods + 1)))
    assert np.abs(model.hazard_shapley(bins, periods) - want).max() < 1e-12


def test_state_is_dealt_to_files_by_rows(spark, monkeypatch):
    """Loans in one partition spread over the tasks of a pass, and the fit stays the same."""
    df = spark.createDataFrame(loans_of(300, 8), SCHEMA).coalesce(1)
    fit = lambda: boosting.fit_boosting(df, NUMBERS, KINDS, trees=3, leaves=4, depth=2, least=5)
    one, seen, real = fit(), [], boosting._pass
    monkeypatch.setattr(boosting, "STATE_ROWS", 50)
    monkeypatch.setattr(boosting, "_pass", lambda state, *rest: (seen.append(len(state.inputFiles())), real(state, *rest))[1])
    many = fit()
    assert max(seen) == 6
    assert np.allclose([h[1] for h in one.history], [h[1] for h in many.history], atol=1e-12)


def test_passes_read_blocks_and_the_last_level_takes_none(spark, monkeypatch):
    df, seen, real = spark.createDataFrame(loans_of(300, 9), SCHEMA).coalesce(1), [], boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda state, *rest: (seen.append(state.count()), real(state, *rest))[1])
    model = boosting.fit_boosting(df, NUMBERS, KINDS, trees=3, depth=2, least=5, rate=0.3)
    assert len(model.trees) == 3 and any(t.left[t.left[0]] >= 0 or t.left[t.right[0]] >= 0 for t in model.trees)
    assert len(seen) <= 2 * 3 + 1 and max(seen) == 1  # rows: a loan each before, and a pass more a tree


def test_splits_are_looked_up_once_a_loan(spark):
    """Values and places of loans over periods against the walk of each row down the tree."""
    df = spark.createDataFrame(loans_of(400, 7, 2.0), SCHEMA)
    model = boosting.fit_boosting(df, NUMBERS, KINDS, months=2, horizon=12, trees=6, leaves=8, depth=4, rate=0.3, least=5, bagging=1.0, features_share=1.0)
    last, bins = len(model.bins.features), model.bins.of(df.limit(50).toPandas())
    assert any((t.feature[t.left >= 0] == last).any() for t in model.trees)
    at = np.minimum(np.arange(1, model.periods + 3), model.periods)
    for tree in model.trees:
        leaf = np.array([tree.leaf_of(np.column_stack([bins, np.full(len(bins), k)])) for k in at])
        margins = np.zeros(leaf.shape)
        tree.add_to(margins, bins.T.astype(np.intp), at)
        assert np.abs(margins - tree.value[leaf]).max() < 1e-15
        nodes, place = [int(i) for i in np.flatnonzero(tree.left < 0)], np.full(leaf.shape, -1)
        for which, slot in tree.reached(nodes, bins.T.astype(np.intp), at):
            assert (place[which] == -1)[:, slot >= 0].all()
            place[which] = np.where(slot >= 0, slot, place[which])
        assert (np.array(nodes)[place] == leaf).all()


def test_batches_have_the_bins_of_frames(spark):
    rows = [(1, float("nan"), None, 0.5, "unseen", 1, 0, 1.0), (2, 0.3, 1.0, None, None, 1, 0, 1.0), *loans_of(40, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    bins = boosting.fit_bins(df, NUMBERS, KINDS, 12)
    assert (bins.of_batch(df.toArrow().combine_chunks().to_batches()[0]).T == bins.of(df.toPandas())).all()
