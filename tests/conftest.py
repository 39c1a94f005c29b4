import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("rolecast-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(values, column expression) → the results in order, evaluated in one job."""
    from pyspark.sql import functions as F

    def run(values, build, kind="string"):
        data = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(data, f"i int, x {kind}").repartition(2)
        return [r[0] for r in df.orderBy("i").select(build(F.col("x")).alias("y"), "i").collect()]

    return run
