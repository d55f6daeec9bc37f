"""The store of deliveries after a crash, given batches again, compacted and cleared."""

import datetime as dt

import pytest

from barlattice.operators.delivery_store import DeliveryStore

SCHEMA = "run_id string, trade_id long, received_at timestamp, delivery_id long"
AT = dt.datetime(2024, 1, 1)


def store(spark, folder):
    return DeliveryStore(spark, str(folder), ("run_id", "trade_id"), "received_at", "delivery_id", 30 * 86_400, 4, 1 << 10)


def batch(spark, ids, first):
    return spark.createDataFrame([("r", i, AT + dt.timedelta(days=i), first + k) for k, i in enumerate(ids)], SCHEMA)


def ids(df):
    return sorted(r.trade_id for r in df.collect())


def test_a_batch_that_died_before_its_commit_is_not_lost(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    assert ids(s.ingest(batch(spark, [1, 2, 2, 3], 0), "a")) == [1, 2, 3]
    with monkeypatch.context() as m:
        m.setattr(s, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.ingest(batch(spark, [3, 4], 10), "b")
    again = store(spark, tmp_path)
    assert ids(again.ingest(batch(spark, [3, 4], 10), "b")) == [4]  # nothing of the dead attempt counts
    assert ids(again.ingest(batch(spark, [3, 4], 10), "b")) == [4]  # the caller may not have kept the answer
    assert ids(again.ingest(batch(spark, [3, 4], 20), "c")) == []
    assert ids(again.ingest(batch(spark, [1, 2, 2, 3], 0), "a")) == [1, 2, 3]


def test_compacted_and_cleared_it_knows_the_same(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(3):
        s.ingest(batch(spark, [10 * k, 10 * k + 1, 5], 100 * k), f"b{k}")
    s.compact()
    s.vacuum()
    assert len(s.files.names("filters")) == 1 and len(s.files.names("ids")) == 3 and len(s.files.names("state")) == 1
    assert ids(s.ingest(batch(spark, [0, 1, 5, 10, 20, 21, 22], 1000), "c")) == [22]
    assert ids(s.ingest(batch(spark, [], 2000).limit(0), "empty")) == []


def test_two_writers_do_not_both_commit(spark, tmp_path):
    s = store(spark, tmp_path)
    version, state = s._state()
    s._commit(version + 1, state)
    with pytest.raises(RuntimeError):
        s._commit(version + 1, state)
