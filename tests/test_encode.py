from canopy.functions import encode
from canopy.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_customer_is_encoded(spark):
    assert catalog.QUERIES["target_encode_all"](spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_unseen_level_gets_the_overall_mean(spark):
    train = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0)], "level int, y double")
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "level int")
    got = {r["level"]: r["enc"] for r in encode.target_encode(train, rows, "level", "y", "enc").collect()}
    assert got == {1: 3.0, 2: 9.0, 3: 5.0, None: 5.0}
