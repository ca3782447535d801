import pytest
from pyspark.sql import functions as F

from orrery.operators import recommend as RC
from orrery.operators import reshape as R
from orrery.session import fresh_path
from orrery.sources import files as FS
from orrery.streaming.ingest import merge_batches, read_current, run_available


def test_jdbc_options_split_only_with_bounds():
    whole = FS.jdbc_options("jdbc:x", "t")
    assert whole == {"url": "jdbc:x", "dbtable": "t"}
    split = FS.jdbc_options("jdbc:x", "t", column="id", bounds=(0, 9), partitions=3, fetchsize=1000)
    assert split["numPartitions"] == "3" and split["upperBound"] == "9" and split["fetchsize"] == "1000"


def test_missing_tables_are_empty(spark):
    papers, edges, objects = FS.load_work(spark, fresh_path(spark, "none"))
    assert papers.count() == edges.count() == objects.count() == 0 and "keywords" in papers.columns


def test_saving_twice_is_refused(spark):
    path = fresh_path(spark, "twice")
    FS.save_tables({"t": spark.range(3)}, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        FS.save_tables({"t": spark.range(3)}, path)


def test_missing_model_says_so(spark, capsys):
    assert RC.Recommender.load(spark, fresh_path(spark, "nomodel")) is None
    assert "rebuild" in capsys.readouterr().out


def test_inventory_skips_the_archive(spark):
    path = fresh_path(spark, "spectra")
    for part in ("a.fits", "archive/b.fits"):
        spark.range(1).selectExpr("cast(id as string)").coalesce(1).write.text(f"{path}/{part}")
    found = FS.file_inventory(spark, f"file:{path}" if path.startswith("/") else path, ".txt").collect()
    assert len(found) == 1 and "archive" not in found[0]["path"]


def test_stream_equals_batch_and_repeats_safely(spark):
    source, target = fresh_path(spark, "in"), fresh_path(spark, "out")
    rows = spark.range(400).select((F.col("id") % 37).alias("objid"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    rows.repartition(6).write.parquet(source)
    got = run_available(spark, source, rows.schema, target, "objid", "seq", files_per_batch=2)
    want = rows.groupBy("objid").agg(F.max("seq").alias("seq"))
    assert got.join(want, ["objid", "seq"]).count() == 37 == got.count()
    handle = merge_batches(target, rows.schema, "objid", "seq")
    before = sorted(map(tuple, read_current(spark, target, rows.schema).collect()))
    handle(rows.limit(10), 2)  # the last batch again, as after a failure
    handle(rows, 2)
    assert sorted(map(tuple, read_current(spark, target, rows.schema).collect())) == before


def test_pivot_raises_on_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "r string, c string, v int")
    with pytest.raises(Exception, match="duplicate cell"):
        R.pivot_unique(df, "r", "c", "v", ["x"]).collect()


def test_bibliography_is_ordered_before_pages_are_parsed(spark):
    import __spark_entry__ as entry

    df = entry.queries()["ext02_bibliography"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The plan is printed from the top: rows are made of pages above the one step that orders all parts.
    assert plan.count("RepartitionByExpression") == 1 and "Sort [" in plan.split("Generate")[0] and ", true" not in plan.split("Generate")[0].split("\n")[0]
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    rows = [(r["p_partkey"], r["score"] is None, -(r["score"] or 0)) for r in df.collect()]
    assert len(rows) > 100 and rows == sorted(rows) and df.rdd.getNumPartitions() > 1
