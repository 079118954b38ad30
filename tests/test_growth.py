"""What one task does, or how often a step is done, does not grow with the table or the number of columns."""

from tidemark.functions import matching
from tidemark.operators import evaluate, explain, models
from tidemark.plans import explain_queries, file_queries, views
from tidemark.streaming import explaining

SF = "/root/testdata/sf0.001"


def test_shares_of_contents_read_each_value_once(spark, monkeypatch):
    reads, read = [], matching.content_number
    monkeypatch.setattr(matching, "content_number", lambda c: reads.append(1) or read(c))
    df = spark.createDataFrame([("5", " x ", None), ("70", "7 months", ""), (None, "y", "  ")], "a string, `b.c` string, gone string")
    features = {"small": matching.Content(0, 10), "large": matching.Content(50, 90), "named": matching.Content(pattern="^[xy]$", levels=("x", "y"))}
    got = matching.content_shares(df, df.columns, features)
    assert len(reads) == 1  # the expression is the same however many columns there are
    assert got["a", "small"] == {"n": 2, "numeric": 1.0, "letters": 0.0, "inside": 0.5, "pattern": 0.0, "levels": 0.0}
    assert got["b.c", "named"] == {"n": 3, "numeric": 1 / 3, "letters": 1.0, "inside": 0.0, "pattern": 2 / 3, "levels": 2 / 3}
    assert got["gone", "large"] == {"n": 0, "numeric": 0.0, "letters": 0.0, "inside": 0.0, "pattern": 0.0, "levels": 0.0}


def test_blocks_of_a_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 40}", "ab"[i % 2]) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(file_queries, "scratch", lambda spark: str(tmp_path / "run"))
    got = {r.doc_id: r.kind for r in file_queries.stream_dedupe_first(spark, str(tmp_path)).collect()}
    assert got == {i: "kept" if i < 40 else "duplicate_row" for i in range(120)}
    assert len(list((tmp_path / "run" / "in").glob("*.parquet"))) > 4  # there were four blocks, a file and so a task each


def test_targets_of_a_block_are_written_and_explained_by_many_tasks(spark, tmp_path, monkeypatch):
    keep = file_queries.stored
    monkeypatch.setattr(file_queries, "stored", lambda df: keep(df.repartition(6)))
    monkeypatch.setattr(file_queries, "scratch", lambda spark: str(tmp_path / "run"))
    monkeypatch.setattr(explaining, "SPREAD", 20)
    run, wanted, killed = file_queries._resumed(spark, SF)
    n, k = wanted.count(), killed.first()
    assert (k.target, k.partial) == (n, True) and 0 < k.done < n
    assert [r["count"] for r in run.ledger(spark).groupBy("batch").count().orderBy("batch").collect()] == [r["count"] for r in wanted.selectExpr("row_id", "min(row_id) OVER () AS lo", "max(row_id) OVER () AS hi").selectExpr("floor((row_id - lo) * 4 / (hi - lo + 1)) AS b").groupBy("b").count().orderBy("b").collect()]
    assert len(list((tmp_path / "run" / "targets").glob("*.parquet"))) > 4  # there were four blocks, a file and so a task each
    assert all(len(list((tmp_path / "run" / "results" / f"batch={b}").glob("*.parquet"))) > 2 for b in range(4))  # one each before


def test_tasks_of_attributions_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 100)
    phi = views.attributions(spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    areas = explain.row_areas(phi)
    assert areas.rdd.getNumPartitions() >= n // 100 > 8
    assert areas._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1  # what goes by row_id is where it is


def test_rows_that_are_learned_from_are_read_once(spark, monkeypatch):
    kept, keep = [], models.stored
    monkeypatch.setattr(models, "stored", lambda df: kept.append(1) or keep(df))
    got = models.standardised(spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id long, x double"), ["x"])
    assert len(kept) == 1 and [(r.id, r.x) for r in got.orderBy("id").collect()] == [(1, -1.0), (2, 0.0), (3, 1.0)]


def test_both_halves_of_a_run_read_it_stored(spark, monkeypatch):
    kept, keep = [], explain_queries.stored
    monkeypatch.setattr(explain_queries, "stored", lambda df: kept.append(1) or keep(df))
    monkeypatch.setattr(explain_queries, "run_of", lambda *_: spark.createDataFrame([(1, 0.25, "approve"), (2, 0.5, "reject"), (3, 0.5, "approve")], "id long, pd_h double, decision string"))
    got = {r.decision: (r.rows, r.total) for r in explain_queries.decision_sinks(spark, "").collect()}
    assert len(kept) == 1 and got == {"approve": (2, 0.75), "reject": (1, 0.5)}


def test_ablation_counts_its_rows_once(spark, monkeypatch):
    counted, count = [], evaluate.cells_of
    monkeypatch.setattr(evaluate, "cells_of", lambda *a: counted.append(1) or count(*a))
    monkeypatch.setattr(explain_queries, "boosted", lambda *_: (spark.range(60).selectExpr("id", "cast(id % 30 + 1 as int) duration_months", "cast(id % 2 as int) event", "cast(id % 7 as double) x"), Fixed))
    got = {r.dropped: (r.concordance, r.auc) for r in explain_queries.ablation_missing(spark, "").collect()}
    scored = spark.range(60).selectExpr("cast(id % 30 + 1 as int) duration_months", "cast(id % 2 as int) event", "round(id % 7 / 7, 6) risk")
    assert len(counted) == 1  # a pass over all scored rows for each measure before
    assert got == {"(none)": (evaluate.concordance(scored).first().concordance, evaluate.cumulative_auc(scored, [12]).first().auc)}


class Fixed:
    bins = type("B", (), {"features": ["x"]})

    @staticmethod
    def ablated(df, groups, periods, keep):
        return df.selectExpr(*keep, "'(none)' dropped", "x / 7 risk")
