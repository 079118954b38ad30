"""Explanations that are killed and taken up again."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.streaming import explaining


def target_files(spark, folder, parts):
    for p in parts:
        spark.createDataFrame([(i, float(i)) for i in p], "row_id long, x double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("row_id long, x double").option("maxFilesPerTrigger", 1).parquet(folder)


def doubled(rows):
    return rows.select("row_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("feature"), (F.col("x") * 2).alias("phi"))


@pytest.mark.parametrize("where", ["explain", "ledger"])
def test_each_target_has_one_result(spark, tmp_path, monkeypatch, where):
    parts = [range(0, 5), range(5, 10), range(3, 12), range(12, 15)]  # the third block repeats earlier targets
    stream = target_files(spark, str(tmp_path / "in"), parts)
    run, calls = explaining.Explanations(str(tmp_path / "run")), []
    wanted = spark.range(15).withColumnRenamed("id", "row_id")

    def explain(rows):
        calls.append(1)
        if len(calls) == 3 and where == "explain":
            raise RuntimeError("killed")
        return doubled(rows)

    if where == "ledger":  # killed between the results of a block and its entry in the ledger
        whole = explaining.Explanations.ledger_path.fget
        monkeypatch.setattr(explaining.Explanations, "ledger_path", property(lambda self: whole(self) if len(calls) != 3 else 1 / 0))
    assert run.of_row(spark, 1) is None and run.last(spark, 3).count() == 0
    with pytest.raises(StreamingQueryException):
        run.run(stream, explain)
    monkeypatch.undo()
    half = run.snapshot(spark, wanted).first()
    assert (half.target, half.done, half.pending, half.partial) == (15, 10, 5, True)
    assert sorted(r.row_id for r in run.pending(spark, wanted).collect()) == list(range(10, 15))
    assert {r.row_id for r in run.results(spark).collect()} == set(range(10))
    run.run(stream, explain)
    got = [(r.row_id, r.feature, r.phi) for r in run.results(spark).collect()]
    assert sorted(got) == sorted((i, f, i * 2.0) for i in range(15) for f in "ab")
    end = run.snapshot(spark, wanted).first()
    assert (end.done, end.pending, end.partial) == (15, 0, False)
    assert [r.row_id for r in run.last(spark, 4).collect()] == [14, 13, 12, 11]
    assert sorted(r.feature for r in run.of_row(spark, 7).collect()) == ["a", "b"]
    run.run(stream, explain)  # nothing new: nothing is done
    assert run.results(spark).count() == 30


def test_only_blocks_that_gain_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).selectExpr("id", "id % 4 AS block", "'waiting' AS state").repartition("block").write.partitionBy("block").parquet(path)
    before = {b: sorted(p.name for p in (tmp_path / "t" / f"block={b}").glob("*.parquet")) for b in range(4)}
    gained = spark.createDataFrame([(6, 2, "done"), (10, 2, "done")], "id long, block int, state string")
    assert explaining.fill_blocks(spark, path, gained, "id", ["state"]) == 1
    after = {b: sorted(p.name for p in (tmp_path / "t" / f"block={b}").glob("*.parquet")) for b in range(4)}
    assert [b for b in range(4) if before[b] != after[b]] == [2]
    got = {r.id: r.state for r in spark.read.parquet(path).collect()}
    assert got == {i: "done" if i in (6, 10) else "waiting" for i in range(40)}


def test_targets(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    ids = lambda d: sorted(r.row_id for r in d.collect())
    assert ids(explaining.targets(df, "row_id")) == list(range(100))
    assert ids(explaining.targets(df, "row_id", mode="first", n=7)) == list(range(7))
    assert ids(explaining.targets(df, "row_id", mode="rows", rows=[5, 500])) == [5]
    one, two = (ids(explaining.targets(df.repartition(k), "row_id", mode="sample", n=10)) for k in (1, 6))
    assert len(one) == 10 and one == two
