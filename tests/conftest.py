import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.local.dir": d, "spark.sql.warehouse.dir": f"{d}/warehouse", "spark.checkpoint.dir": f"file://{d}/shared", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
