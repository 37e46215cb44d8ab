"""Numbers without gaps over ranges, and a log that grows."""

import random

from quernstone.operators import cases, delivery
from quernstone.operators.tables import gapless
from quernstone.plans.queries import set_checkpoints


def test_numbers_follow_the_order(spark):
    set_checkpoints(spark)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, id int").repartition(7)
    got = gapless(df, ["k", "id"], "seq", after=10).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(11, 3011))
    assert [(r.k, r.id) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert gapless(df.limit(0), ["k"], "seq").count() == 0


def test_replays_add_nothing(spark):
    set_checkpoints(spark)
    first = spark.createDataFrame([(f"a{i}", i) for i in range(40)], "id string, at int")
    log = gapless(first, ["at"], "seq")
    again = delivery.append_rows(log, first, ["at"])
    assert sorted((r.id, r.seq) for r in again.collect()) == sorted((r.id, r.seq) for r in log.collect())
    more = delivery.append_rows(log, spark.createDataFrame([("b", 1), ("b", 1), ("a3", 3), ("c", 0)], "id string, at int"), ["at"])
    assert {r.id: r.seq for r in more.where("seq > 40").collect()} == {"c": 41, "b": 42}


def test_case_ids(spark):
    set_checkpoints(spark)
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(1200)], "case_key string")
    got = {r.case_key: r.case_id for r in cases.numbered(df).collect()}
    assert got["k0000"] == "case-001" and got["k1199"] == "case-1200" and len(set(got.values())) == 1200
