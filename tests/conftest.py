import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""
    from pyspark.sql import functions as F

    def value(expression, **fields):
        row = spark.createDataFrame([tuple(fields.values())], ", ".join(
            f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}"
            for k, v in fields.items()
        )) if fields else spark.range(1)
        return row.select(expression.alias("v")).first()["v"]

    return value
