import pytest


@pytest.fixture()
def many_chunks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)
