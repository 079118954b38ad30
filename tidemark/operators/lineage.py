"""Where columns come from: the analysed plan walked from its output down to the columns of its sources.

A renamed, cast or combined column keeps its ancestors; a harmless column that bears a blocked name has
none of them. What was stored and read again has no history: check before storing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.sources.tables import LEAKAGE, LeakageError

#: How a plan node calls the expressions that make its columns.
_MAKES = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}


class Lineage:
    """parents: attribute id -> the ids that it is made of; names; leaves: the ids of source columns; output: (name, id) of the frame's columns."""

    def __init__(self, df: DataFrame):
        self.parents: dict[int, set[int]] = {}
        self.names: dict[int, str] = {}
        self.leaves: set[int] = set()
        plan = df._jdf.queryExecution().analyzed()
        self._walk(plan)
        self.output = [(a.name(), a.exprId().id()) for a in _items(plan.output())]

    def _references(self, expression) -> set[int]:
        found = {a.exprId().id() for a in _items(expression.references().toSeq())}
        todo = [expression]
        while todo:  # subqueries inside
            e = todo.pop()
            if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists"):
                self._walk(e.plan())
                found |= {a.exprId().id() for a in _items(e.plan().output())}
            todo += _items(e.children())
        return found

    def _walk(self, plan) -> None:
        children = _items(plan.children())
        for c in children:
            self._walk(c)
        kind, output = plan.getClass().getSimpleName(), _items(plan.output())
        below = [[a.exprId().id() for a in _items(c.output())] for c in children]
        for e in _items(getattr(plan, _MAKES[kind])()) if kind in _MAKES else ():
            if e.getClass().getSimpleName() == "Alias":
                self.parents.setdefault(e.exprId().id(), set()).update(self._references(e))
        made = self._references(plan.generator()) if kind == "Generate" else None
        for k, a in enumerate(output):
            i = a.exprId().id()
            self.names[i] = a.name()
            if not children:
                self.leaves.add(i)
            elif kind == "Union":
                self.parents.setdefault(i, set()).update(b[k] for b in below if b[k] != i)
            elif i not in self.parents and not any(i in b for b in below):  # no expression explains it: all below may
                self.parents[i] = made if made is not None else set().union(*map(set, below))

    def reach(self, i: int) -> set[int]:
        """The id and all that it is made of."""
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.parents.get(x, ())
        return seen


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def sources(df: DataFrame) -> dict[str, list[str]]:
    """Output column -> the source columns that it is made of; what Python made is made of all that it read."""
    line = Lineage(df)
    return {name: sorted({line.names[x] for x in line.reach(i) & line.leaves}) for name, i in line.output}


def leaks(df: DataFrame, source: DataFrame | None = None, blocked: tuple[str, ...] = LEAKAGE) -> dict[str, list[str]]:
    """Output column -> the blocked columns it is made of: those of `source`, a frame that df was made from, or without it those of the plan's leaves."""
    line = Lineage(df)
    barred = {i: line.names[i] for i in line.leaves} if source is None else {a.exprId().id(): a.name() for a in _items(source._jdf.queryExecution().analyzed().output())}
    barred = {i: n for i, n in barred.items() if n in blocked}
    found = {name: sorted({barred[x] for x in line.reach(i) & barred.keys()}) for name, i in line.output}
    return {c: names for c, names in found.items() if names}


def guard_lineage(df: DataFrame, source: DataFrame | None = None, blocked: tuple[str, ...] = LEAKAGE) -> DataFrame:
    """The frame itself, unless a column of it is made of a blocked one."""
    if found := leaks(df, source, blocked):
        raise LeakageError("columns known only after the outcome: " + "; ".join(f"{c} comes from {', '.join(names)}" for c, names in sorted(found.items())))
    return df
