"""An uploaded file against what a model was trained on: what is read, derived, filled or refused, and the rows made ready.

The plan is made from column names and the saved specification alone; the rows are made ready by
expressions, so every block of a file is read the same way. A value in a row is used as cleaning reads
it; a trained column that the file lacks is restored: as missing where training saw it missing, else
with the training rows' stand-in, since the model has no route for its absence.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators.clean import fit_levels
from tidemark.operators.design import RULES, closure, cost_tiers, derive, stand_ins


class UploadRefused(ValueError):
    """Features are missing that the model can't do without."""


@dataclass
class Specification:
    """What scoring needs of the training rows: the features in order, levels of the categories, each feature's tier and stand-in."""

    numeric: list[str]
    categorical: list[str]
    levels: dict[str, list[str]]
    tiers: dict[str, str]
    stand_ins: dict[str, str]
    structural: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Specification:
        return cls(**json.loads(spark.read.text(path).first()[0]))


def fit_specification(train: DataFrame, numeric: list[str], categorical: list[str], drops: dict[str, float], structural: list[str] = [], most: int = 200) -> Specification:  # noqa: B006
    """From the training rows: drops is what ablation measured, the loss of concordance without a feature; unmeasured features are in no tier but that. `most` levels a category at most."""
    fills = stand_ins(train, numeric, categorical)
    costs = fills.select(F.col("column").alias("feature"), F.col("missing_rate").alias("train_missing"), "stand_in", F.try_element_at(F.create_map(*[F.lit(x) for p in drops.items() for x in p]) if drops else F.create_map().cast("map<string,double>"), F.col("column")).alias("drop"))
    rows = cost_tiers(costs, structural).collect()  # a row a feature
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    for r in fit_levels(train, categorical, 0).where(F.col("rank") <= most).orderBy("column", "level").collect() if categorical else ():
        levels[r["column"]].append(r.level)
    return Specification(numeric, categorical, levels, {r.feature: r.tier for r in rows}, {r.feature: r.stand_in for r in rows if r.stand_in is not None}, list(structural))


@dataclass
class Plan:
    """What becomes of each feature and of the file's other columns.

    renamed: column -> feature; derived: feature -> what it is made of; missing: feature -> why; filled:
    feature -> stand-in; ignored: column -> why; refused: features whose absence blocks the run.
    """

    renamed: dict[str, str]
    derived: dict[str, list[str]]
    missing: dict[str, str]
    filled: dict[str, str]
    ignored: dict[str, str]
    refused: list[str]
    warnings: list[str]

    def table(self, spark: SparkSession, spec: Specification) -> DataFrame:
        """(feature, status, detail): every feature, in order, then the ignored columns."""
        back = {f: c for c, f in self.renamed.items()}
        rows = []
        for f in spec.features:
            status = "refused" if f in self.refused else "filled" if f in self.filled else "missing" if f in self.missing else "derived" if f in self.derived else "renamed" if f in back else "read"
            rows.append((f, status, self.filled.get(f) or self.missing.get(f) or ", ".join(self.derived.get(f, [])) or back.get(f, "")))
        rows += [(c, "ignored", why) for c, why in self.ignored.items()]
        return spark.createDataFrame(rows, "feature string, status string, detail string")


def plan(columns: list[str], spec: Specification, mapping: dict[str, str] | None = None, *, id_column: str | None = None, fill: bool = True) -> Plan:
    """mapping: column -> feature as it was confirmed. fill: features that training never saw missing get their stand-in; otherwise their absence blocks the run."""
    names = [c.strip() for c in columns]
    renamed = {c: f for c, f in (mapping or {}).items() if c in names and f not in names and c != f}
    have = {renamed.get(c, c) for c in names}
    rules = {r.feature: r for r in RULES}
    reach, todo = set(have), [c for c in closure([f for f in spec.features if f not in have]) if c in rules]
    while ready := [c for c in todo if c not in reach and reach.issuperset(rules[c].needs)]:
        reach |= set(ready)
    derived = {f: list(rules[f].needs) for f in spec.features if f not in have and f in reach}
    missing = {f: f"needs {' and '.join(sorted(set(rules[f].needs) - reach))}" if f in rules else "not in file" for f in spec.features if f not in reach}
    refused = [f for f in missing if spec.tiers.get(f) == "required"]
    unlearned = [f for f in missing if spec.tiers.get(f) == "unlearned"]
    filled = {f: spec.stand_ins[f] for f in unlearned if f in spec.stand_ins} if fill else {}
    refused += [] if fill else unlearned
    used: dict[str, list[str]] = {}
    for f in closure(list(derived)):
        if f in rules and f in reach and f not in have:
            for c in rules[f].needs:
                used.setdefault(c, []).append(f)
    ignored = {c: f"used for {', '.join(sorted(used[renamed.get(c, c)]))}" if renamed.get(c, c) in used else "no feature of the model" for c in names if renamed.get(c, c) not in spec.features and c != id_column}
    warnings = [f"{len(renamed)} columns are read under another name"] if renamed else []
    warnings += [f"{len(derived)} features are computed from other columns"] if derived else []
    warnings += [f"{f} is not in the file: every row gets the training value {v}, so results are unsure where it matters" for f, v in filled.items()]
    left = [f for f in missing if f not in filled and f not in refused]
    warnings += [f"{len(left)} of {len(spec.features)} features are treated as missing: {', '.join(left)}"] if left else []
    warnings += [f"{f} is left missing, though training never was without it and no stand-in is known" for f in unlearned if fill and f not in filled]
    return Plan(renamed, derived, missing, filled, ignored, refused, warnings)


def prepared(df: DataFrame, made: Plan, spec: Specification, keep: list[str]) -> DataFrame:
    """keep, exactly the trained features in order, a `_missing` flag for the structural ones, and unreadable and unseen: how many of a row's values are neither empty nor usable.

    Raises UploadRefused for a plan with refused features.
    """
    if made.refused:
        raise UploadRefused(f"the file lacks {', '.join(made.refused)}")
    work = df.select([F.col(f"`{c}`").alias(made.renamed.get(c.strip(), c.strip())) for c in df.columns])
    texts = {c for c, t in work.dtypes if t == "string"}

    def number(c: str) -> Column:
        if c not in texts:
            x = F.col(c).cast("double")
            return F.when(~F.isnan(x), x)
        return parse.term_months(F.col(c)).cast("double") if c == "term_months" else parse.number(F.col(c))

    raw = {f: parse.present(F.col(f)) for f in spec.features if f in texts}
    numbers = {c for r in RULES for c in (r.feature, *r.needs)} - {"term", "emp_length"}
    read = work.select("*", *[F.col(f).alias(f"_raw_{f}") for f in raw])
    read = read.withColumns({c: number(c) for c in work.columns if c in spec.numeric or c in numbers})
    read, _ = derive(read, tuple(r for r in RULES if r.feature in closure(list(made.derived))))
    present = lambda f: f in read.columns

    def value(f: str) -> Column:
        if f in spec.categorical:
            text = parse.present(F.col(f).cast("string")) if present(f) else F.lit(made.filled.get(f)).cast("string")
            return F.when(text.isin(*spec.levels[f]), text) if spec.levels[f] else F.lit(None).cast("string")
        return F.col(f).cast("double") if present(f) else F.lit(float(made.filled[f]) if f in made.filled else None).cast("double")

    out = {f: value(f) for f in spec.features}
    out |= {f"{f}_missing": F.isnull(value(f)).cast("int") for f in spec.structural}
    odd = lambda fs: sum((F.when(parse.present(F.col(f"_raw_{f}")).isNotNull() & value(f).isNull(), 1).otherwise(0) for f in fs if f in raw), F.lit(0)).cast("long")
    return read.select(*keep, *[c.alias(n) for n, c in out.items()], odd(spec.numeric).alias("unreadable"), odd(spec.categorical).alias("unseen"))
