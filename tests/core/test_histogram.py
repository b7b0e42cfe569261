from pyspark.sql import functions as F

from helixframe.operators import pairs
from helixframe.plans import queries

SF = "/root/testdata/sf0.001"


def test_no_size_is_lost(spark):
    n = queries.sizes(spark, SF).count()
    r = queries.QUERIES["insert_hist"](spark, SF).agg(F.sum("n"), F.max("upto"), F.max("n_below"), F.max("n_above")).first()
    assert r[0] == r[1] and r[0] + r[2] + r[3] == n


def test_sizes_out_of_range_are_counted(spark):
    s = spark.createDataFrame([(x,) for x in [*range(300, 400), -5000, 9000, 9001]], "isize long")
    h = pairs.derived_histogram(s).collect()
    assert sum(r.n for r in h) == 100 and {(r.n_below, r.n_above) for r in h} == {(1, 2)}
    same = pairs.derived_histogram(spark.createDataFrame([(7,)] * 5, "isize long")).collect()
    assert [tuple(r) for r in same] == [(0, 7, 1, 5, 0, 0)]
