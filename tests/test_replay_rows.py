"""What the replay steps carry through their ranges."""

from pyspark.sql import functions as F

from flowlens.operators import behaviour as B
from flowlens.operators.ordering import ranged, ranked


def test_rank_is_read_off_a_ranged_table(spark):
    rows = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = ranked(ranged(rows, ["x", "id"], "t", 5)).orderBy("x", "id").select("rank").collect()
    assert [r[0] for r in got] == list(range(1, 1001))


def test_replay_ranges_hold_no_whole_flows():
    assert "byte_count" not in B.REPLAYED and "flow_id" in B.REPLAYED
