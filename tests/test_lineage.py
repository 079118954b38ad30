"""Leakage by what a column is made of, not by what it is called."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.sources.tables import LeakageError


@pytest.fixture
def loans(spark, tmp_path):
    spark.createDataFrame([(1, "Current", 5.0, 10.0, 3), (2, "Default", 6.0, 11.0, 4)], "id long, loan_status string, dti double, out_prncp double, grade int").write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


REFUSED = {
    "renamed": lambda d: d.select(F.col("loan_status").alias("state_of_loan")),
    "cast": lambda d: d.select("id", F.col("out_prncp").cast("string").alias("text")),
    "mixed in": lambda d: d.withColumn("ratio", F.col("dti") / (1 + F.col("out_prncp"))).select("ratio"),
    "conditional": lambda d: d.select(F.when(F.col("loan_status") == "Default", 1).otherwise(0).alias("flag")),
    "aggregated": lambda d: d.groupBy("grade").agg(F.max("out_prncp").alias("m")),
    "grouped by": lambda d: d.groupBy(F.col("loan_status").alias("s")).count().select("s"),
    "window": lambda d: d.select("id", F.sum("out_prncp").over(Window.partitionBy("grade")).alias("w")),
    "exploded": lambda d: d.select("id", F.explode(F.array("dti", "out_prncp")).alias("x")),
    "united": lambda d: d.select(F.col("dti").alias("x")).unionAll(d.select(F.col("out_prncp").alias("x"))),
    "joined": lambda d: d.select("id", "dti").join(d.select(F.col("id").alias("other"), F.col("loan_status").alias("s")), F.col("id") == F.col("other")).select("dti", "s"),
    "by Python": lambda d: d.select("id", "loan_status").mapInPandas(lambda parts: parts, "id long, anything string"),
    "subquery": lambda d: (d.createOrReplaceTempView("lineage_t"), d.sparkSession.sql("SELECT dti, (SELECT max(out_prncp) FROM lineage_t) AS top FROM lineage_t"))[1],
    "twice renamed": lambda d: d.withColumnRenamed("loan_status", "a").withColumn("b", F.upper("a")).drop("a"),
}
ALLOWED = {
    "plain": lambda d: d.select("id", "dti", "grade"),
    "harmless column of a blocked name": lambda d: d.select("id", F.col("dti").alias("loan_status")),
    "dropped": lambda d: d.withColumn("x", F.col("dti") * 2).drop("loan_status", "out_prncp"),
    "filtered by": lambda d: d.where("loan_status = 'Default'").select("dti"),
    "aggregated": lambda d: d.groupBy("grade").agg(F.avg("dti").alias("out_prncp")),
    "Python over harmless columns": lambda d: d.select("id", "dti").mapInPandas(lambda parts: parts, "id long, loan_status double"),
}


@pytest.mark.parametrize("name", sorted(REFUSED))
def test_refused(loans, name):
    df = REFUSED[name](loans)
    with pytest.raises(LeakageError):
        lineage.guard_lineage(df)
    assert set(sum(lineage.leaks(df).values(), [])) <= {"loan_status", "out_prncp"}


@pytest.mark.parametrize("name", sorted(ALLOWED))
def test_allowed(loans, name):
    df = ALLOWED[name](loans)
    assert lineage.guard_lineage(df) is df


def test_columns_made_on_the_way_are_known_by_their_frame(loans):
    view = loans.select("id", F.upper("loan_status").alias("recoveries"), "dti")  # made here: no leaf bears the name
    bad = view.select((F.length("recoveries") + 1).alias("n"))
    assert lineage.leaks(bad, view) == {"n": ["recoveries"]} and lineage.leaks(view.select("dti"), view) == {}
    assert lineage.sources(bad) == {"n": ["loan_status"]} and lineage.sources(view.select("dti", "id")) == {"dti": ["dti"], "id": ["id"]}
