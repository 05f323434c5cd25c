"""Work that is done once for a line."""

from pyspark.sql import functions as F

from loomdex.functions import outline as ol
from loomdex.plans.catalog.conversion import toc_parse

SF = "/root/testdata/sf0.001"


def test_the_contents_pattern_runs_once_a_line(spark):
    plan = toc_parse(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract(" not in plan


def test_contents_lines_with_marks(spark):
    lines = ["1.2 Rain ..... 7", "\x011\x01Rain\x017", "1 Ra\x01in .. 7", "x", "", None, "3 Floods .. 99999999999", "1.2.3.4.5.6 Deep . 1", " 4 a b •• 12 \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i long, t string")
    got = {r.i: tuple(r.e) if r.e else None for r in df.select("i", ol.toc_entry(F.col("t")).alias("e")).collect()}
    want = {0: (2, "Rain", 6), 7: (5, "Deep", 0), 8: (1, "a b", 11)}
    assert got == {i: want.get(i) for i in range(len(lines))}
