"""Every query with Python workers runs on executors that do not have the package."""

import os
import subprocess
import sys
import textwrap

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"
QUERIES = [
    "op1_language_id", "op2_html_text", "op4_toxicity", "op8_simhash", "op9_suffix_dedup",
    "op10_pack_windows", "op11_license_scan", "op12_ranked_search", "op13_vector_codes",
    "pipeline", "model_batch", "cox_hr",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        from pyspark.sql import SparkSession
        spark = (
            SparkSession.builder.master("local[4]")
            .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
            .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")

        def hidden(batches):
            import importlib.util
            assert importlib.util.find_spec("cohortsmith") is None
            yield from batches

        assert spark.range(9).mapInArrow(hidden, "id long").count() == 9
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__
        for name in {QUERIES!r}:
            assert __spark_entry__.queries()[name](spark, {FOLDER!r}).count() > 0, name
            print("ran", name)
        from cohortsmith.models import Num, cox_hr, logistic_or
        df = spark.range(60).selectExpr(
            "id % 7 AS x", "CAST(id % 3 = 0 AS INT) AS y", "CAST(id % 11 + 1 AS DOUBLE) AS t")
        assert logistic_or(df, "y", [Num("x")], max_patterns=0).count() == 2
        assert cox_hr(df, "t", "y", [Num("x")], max_patterns=0).count() == 1
        print("ran all")
    """))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=900,
    )
    assert "ran all" in done.stdout, done.stdout + done.stderr[-3000:]
