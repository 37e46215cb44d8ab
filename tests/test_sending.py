"""Deliveries in waves to a destination that keeps one file for each idempotency key."""

import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quernstone.operators import delivery, sending
from quernstone.plans.queries import set_checkpoints

READY = "run_id string, key string, generation long, payload map<string,string>"


def destination(folder, lose=None):
    """A transport that stores a record once; lose(key, stored) may raise, or end its process, after a record was stored."""

    def transport():
        def post(key, payload):
            name = os.path.join(folder, key.replace("|", "_"))
            try:
                os.close(os.open(name, os.O_CREAT | os.O_EXCL))
                answer = (200, "accepted", payload["n"])
            except FileExistsError:
                answer = (200, "duplicate", payload["n"])
            with open(name, "a") as f:  # a byte for each post
                f.write(".")
            if lose:
                lose(key)
            return answer

        return post

    return transport


def held_by(folder):
    return lambda unsure: unsure.where(F.col("idempotency_key").isin([n.replace("_", "|") for n in os.listdir(folder)]))


def once(marker):
    """A function that is true at its first call in any process."""

    def first():
        try:
            os.close(os.open(marker, os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False

    return first


def rows(spark, n):
    return spark.createDataFrame([("r", f"k{i}", 0, {"n": str(i)}) for i in range(n)], READY)


def folders(tmp_path):
    (tmp_path / "held").mkdir()
    return str(tmp_path / "held"), str(tmp_path / "log")


def run(spark, ready, path, transport, reconcile, **more):
    return sending.deliver_in_waves(ready, path, sending.sender(transport, parallel=3), reconcile, **{"waves": 2, "backoff": ()} | more)


def test_delivers_once(spark, tmp_path):
    set_checkpoints(spark)
    held, path = folders(tmp_path)
    twice = rows(spark, 30).unionByName(rows(spark, 5)).unionByName(spark.createDataFrame([("r", None, 0, None)], READY))
    log = run(spark, twice, path, destination(held), held_by(held))
    assert sorted((r.key, r.outcome, r.target_id, r.seq) for r in log.collect()) == sorted((f"k{i}", "accepted", str(i), 1) for i in range(30))
    assert delivery.accepted_keys(log).count() == 30 and set(log.columns) == set(sending.LOG)
    run(spark, twice, path, destination(held), held_by(held))
    assert all(os.path.getsize(os.path.join(held, n)) == 1 for n in os.listdir(held)) and len(os.listdir(held)) == 30
    assert run(spark, rows(spark, 0), str(tmp_path / "none"), destination(held), held_by(held)).count() == 0


@pytest.mark.parametrize("end", ["error", "exit"])
def test_a_lost_task_loses_and_doubles_nothing(spark, tmp_path, end):
    set_checkpoints(spark)
    held, path = folders(tmp_path)
    first = once(str(tmp_path / "marker"))

    def lose(key):
        if key == "r|k7|gen0" and first():
            if end == "exit":
                os._exit(1)
            raise RuntimeError("the task ends here")

    log = run(spark, rows(spark, 40), path, destination(held, lose), held_by(held))
    assert len(os.listdir(held)) == 40 and {r.key for r in delivery.accepted_keys(log).collect()} == {f"k{i}" for i in range(40)}
    last = {r.key: r.outcome for r in log.orderBy("seq").collect()}
    assert last["k7"] == "duplicate" and set(last.values()) <= {"accepted", "duplicate"}


def test_timeouts_are_settled_by_the_destination(spark, tmp_path):
    set_checkpoints(spark)
    held, path = folders(tmp_path)

    def lose(key):
        if key.endswith("3|gen0"):
            raise TimeoutError

    log = {(r.key, r.seq): r.outcome for r in run(spark, rows(spark, 20), path, destination(held, lose), held_by(held)).collect()}
    assert log == {(f"k{i}", 1): "duplicate" if i % 10 == 3 else "accepted" for i in range(20)}


def test_a_lost_driver_goes_on(spark, tmp_path):
    """The first driver ends after a wave and a half; what it posted without a log line is answered as a duplicate."""
    set_checkpoints(spark)
    held, path = folders(tmp_path)
    whole, calls = sending.sender(destination(held), parallel=3), []

    def ends(records, attempt):
        calls.append(attempt)
        if len(calls) == 2:
            whole(records, attempt).limit(1000).collect()
            raise KeyboardInterrupt
        return whole(records, attempt)

    with pytest.raises(KeyboardInterrupt):
        sending.deliver_in_waves(rows(spark, 40), path, ends, held_by(held), waves=4, backoff=())
    known = sending.read_attempts(spark, path).count()
    assert 0 < known < len(os.listdir(held)) < 40
    log = sending.deliver_in_waves(rows(spark, 40), path, whole, held_by(held), waves=4, backoff=())
    assert log.count() == 40 and len(os.listdir(held)) == 40
    assert log.where("outcome = 'duplicate'").count() > 0 and delivery.accepted_keys(log).count() == 40


def test_attempts_number_on(spark, tmp_path):
    set_checkpoints(spark)
    held, path = folders(tmp_path)
    busy = lambda: lambda key, payload: (503, None, None)
    nobody = lambda unsure: unsure.limit(0)
    first = run(spark, rows(spark, 4), path, busy, nobody, attempts=2)
    assert sorted((r.seq, r.outcome) for r in first.collect()) == [(1, "transient")] * 4 + [(2, "transient")] * 4
    log = run(spark, rows(spark, 4), path, destination(held), nobody)
    assert sorted((r.seq, r.outcome) for r in log.where("seq > 2").collect()) == [(3, "accepted")] * 4 and log.count() == 12
    again = rows(spark, 4).withColumn("generation", F.lit(1).cast("long"))
    assert run(spark, again, path, destination(held), nobody).where("generation = 1 and outcome = 'accepted' and seq = 4").count() == 4


def test_a_broken_transport_is_an_error(spark, tmp_path):
    set_checkpoints(spark)
    held, path = folders(tmp_path)

    def broken():
        raise RuntimeError("no such host")

    with pytest.raises(PySparkException, match="no such host"):
        run(spark, rows(spark, 6), path, broken, held_by(held), waves=1)
    assert sorted((r.seq, r.outcome) for r in sending.read_attempts(spark, path).collect()) == [(n, "uncertain") for n in (1, 2, 3) for _ in range(6)]
    assert run(spark, rows(spark, 6), path, destination(held), held_by(held)).where("seq = 4 and outcome = 'accepted'").count() == 6


def test_rate(spark, tmp_path):
    set_checkpoints(spark)
    held, _ = folders(tmp_path)
    ready = rows(spark, 60).withColumn("idempotency_key", F.concat(F.lit("r|"), "key"))
    began = time.monotonic()
    assert sending.sender(destination(held), parallel=2, rate=20)(ready, 1).count() == 60
    assert time.monotonic() - began > 2.0
