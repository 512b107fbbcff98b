import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.operators import upsert as U
from tidewater.sources import versions as V
from tidewater.sources.versions import Buckets

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def base(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS vers")
    yield "vers"
    spark.sql("DROP DATABASE vers CASCADE")


def content(spark, name):
    return sorted(map(tuple, spark.table(name).collect()))


def test_commits_swap_whole_versions(spark, base, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    V.commit(a, "vers.t", str(tmp_path))
    first, reader = V.location(spark, "vers.t"), spark.table("vers.t")
    now = spark.table("vers.t")
    V.commit(U.upsert(now, spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string"), ["k"]), "vers.t", str(tmp_path))  # reads what it replaces
    assert content(spark, "vers.t") == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, reader.collect())) == [(1, "a"), (2, "b")], "a plan made before goes on with its version"
    assert len(V.versions(spark, "vers.t", str(tmp_path))) == 2
    V.back_to(spark, "vers.t", first)
    assert content(spark, "vers.t") == [(1, "a"), (2, "b")]
    for k in range(3):
        V.commit(a.withColumn("k", F.col("k") + k), "vers.t", str(tmp_path))
    gone = V.vacuum(spark, "vers.t", str(tmp_path), keep=1)
    assert len(gone) == 4 and content(spark, "vers.t") == [(3, "a"), (4, "b")]


def test_new_columns_and_wrong_ones(spark, base, tmp_path):
    V.commit(spark.createDataFrame([(1, "a")], "k long, v string"), "vers.t", str(tmp_path))
    V.commit(spark.createDataFrame([(True, "b", 2)], "w boolean, v string, k long"), "vers.t", str(tmp_path))
    assert spark.table("vers.t").columns == ["k", "v", "w"] and content(spark, "vers.t") == [(2, "b", True)]
    for df in (spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([("1", "a", True)], "k string, v string, w boolean")):
        with pytest.raises(ValueError):
            V.commit(df, "vers.t", str(tmp_path))
    with pytest.raises(ValueError):
        V.commit(spark.table("vers.t"), "vers.t", str(tmp_path), Buckets(2, ("k",)))
    with pytest.raises(ValueError):
        V.commit(spark.table("vers.t"), "vers.t; drop", str(tmp_path))
    assert content(spark, "vers.t") == [(2, "b", True)]


def test_a_failed_write_leaves_the_table(spark, base, tmp_path):
    """Some tasks have written their files when another one fails."""
    V.commit(spark.range(100).select(F.col("id").alias("k")), "vers.t", str(tmp_path), Buckets(4, ("k",)))
    bad = spark.range(1000, 2000, numPartitions=8).select(F.when(F.col("id") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("k"))
    for df in (bad, bad.repartition(8)):
        with pytest.raises(Exception, match="lost"):
            V.commit(df, "vers.t", str(tmp_path), Buckets(4, ("k",)))
    assert content(spark, "vers.t") == [(k,) for k in range(100)]
    assert [t.name for t in spark.catalog.listTables("vers")] == ["t"] and len(V.versions(spark, "vers.t", str(tmp_path))) == 1


def test_bucketed_versions_join_without_a_shuffle(spark, base, tmp_path):
    b = Buckets(4, ("a", "b"), ("a", "b", "d"))
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), F.col("id").alias("d"))
    V.commit(rows.withColumn("x", F.lit(1)), "vers.x", str(tmp_path), b)
    V.commit(rows.withColumn("y", F.lit(1)), "vers.y", str(tmp_path), b)
    V.commit(rows.withColumn("y", F.lit(2)), "vers.y", str(tmp_path), b)  # buckets outlive a swap
    before, other = dict(spark.conf.getAll), V.colocating(spark)
    x, y = other.table("vers.x"), other.table("vers.y")
    assert dict(spark.conf.getAll) == before and other.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    joined = x.hint("merge").join(y, ["a", "b", "d"])
    assert joined.count() == 500 and joined.agg(F.sum("y")).first()[0] == 1000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


DRIVER = """
import sys
from pyspark.sql import SparkSession, functions as F
from tidewater.sources import versions as V
where, what = sys.argv[1:]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{where}/wh")
    .config("spark.hadoop.javax.jdo.option.ConnectionURL", f"jdbc:derby:;databaseName={where}/meta;create=true").enableHiveSupport().getOrCreate())
spark.sql("CREATE DATABASE IF NOT EXISTS d")
if what == "kill":
    V.commit(spark.range(10).select(F.col("id").alias("k")), "d.t", f"{where}/root")
    slow = F.udf(lambda x: __import__("time").sleep(0.2 if x % 100 else 0) or x, "long")
    V.commit(spark.range(100, 1100, numPartitions=50).select(slow("id").alias("k")), "d.t", f"{where}/root")
    print("too late")
else:
    print("rows", sorted(r.k for r in spark.table("d.t").collect()) == list(range(10)), len(V.versions(spark, "d.t", f"{where}/root")))
    print("vacuumed", len(V.vacuum(spark, "d.t", f"{where}/root", keep=0)), spark.table("d.t").count())
"""


def test_a_killed_driver_leaves_the_table(tmp_path):
    """The driver dies while the second version is half written; another driver, on the same catalog, reads the first one."""
    script = tmp_path / "driver.py"
    script.write_text(DRIVER)
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    p = subprocess.Popen([sys.executable, str(script), str(tmp_path), "kill"], env=env, cwd=tmp_path, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        until = time.time() + 120
        while len(list((tmp_path / "root").glob("d.t/*/_temporary/**/part-*"))) < 3:  # of the version under way
            assert time.time() < until and p.poll() is None
            time.sleep(0.2)
    finally:
        os.killpg(p.pid, signal.SIGKILL)
        p.wait()
    for lock in (tmp_path / "meta").glob("*.lck"):
        lock.unlink()
    out = subprocess.run([sys.executable, str(script), str(tmp_path), "read"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "rows True 2" in out.stdout and "vacuumed 1 10" in out.stdout, out.stdout + out.stderr[-2000:]
