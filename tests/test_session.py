import os
import subprocess
import sys
import textwrap

from panelspark.session import clear_scratch, materialise, scratch_path

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scratch_tables_go(spark):
    stored = materialise(spark.range(5), "x")
    assert stored.count() == 5 and scratch_path(spark, "x") != scratch_path(spark, "x")
    path = stored.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    clear_scratch(spark)
    assert not os.path.exists(path)


def test_workers_need_not_have_the_package(tmp_path):
    """Only the driver of this run can import the package: workers start in another folder without a path to it."""
    code = f"""
        import sys
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate())
        sys.path.insert(0, {REPO!r})
        import datetime
        from panelspark.operators.stationarity import adf_test
        rows = [("a", datetime.date(2024, 1, 1) + datetime.timedelta(i), float(i * i % 7)) for i in range(40)]
        print("n_obs", adf_test(spark.createDataFrame(rows, "k string, d date, v double"), "k", "d", "v").first()["n_obs"])
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "n_obs" in done.stdout, done.stderr[-2000:]
