import pytest

from logloom.llm import sharding
from logloom.llm.scratch import Scratch


def test_round_trip_and_versions(spark):
    df = spark.range(400).selectExpr("id doc_id", "repeat('x', cast(id as int)) text", "'s' shard", "1 tier")
    root = Scratch(spark, "t").root
    store = sharding.shard(df, target_bytes=20000, arrival_bytes=2000, root=root)
    assert store.version() == 2
    back = store.read()
    assert sorted((r.doc_id, r.text, r.tier) for r in back.collect()) == [(i, "x" * i, 1) for i in range(400)]
    m = {r.shard: r for r in store.manifest().collect()}
    assert sum(r.n_docs for r in m.values()) == 400 and max(r.n_bytes for r in m.values()) <= 22000 + 400
    assert sum(r.n_bytes >= 15000 for r in m.values()) >= 3
    # a later arrival does not touch what is big enough
    store.append(spark.createDataFrame([(1000, "y" * 50), (None, None)], "doc_id long, text string"), 2000)
    assert store.version() == 3 and store.manifest(2).count() == len(m)
    assert {r.doc_id for r in store.read().collect()} == {*range(400), 1000, None}


def test_commit_is_exclusive(spark):
    store = sharding.ShardStore(spark, Scratch(spark, "t").root)
    rows = spark.createDataFrame([], sharding.MANIFEST)
    store.commit(rows, 1)
    with pytest.raises(RuntimeError):
        store.commit(rows, 1)
    assert store.version() == 1


def test_two_writers_from_one_version(spark):
    """Both wrote their data; the second to publish fails and changes nothing."""
    root = Scratch(spark, "t").root
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    a.append(spark.createDataFrame([(1, "one")], "doc_id long, text string"), 10)
    b.version = lambda: 0
    with pytest.raises(RuntimeError):
        b.append(spark.createDataFrame([(2, "two")], "doc_id long, text string"), 10)
    assert a.version() == 1 and [r.doc_id for r in a.read().collect()] == [1]


def test_a_job_that_died_before_its_commit_is_repeated(spark):
    store = sharding.ShardStore(spark, Scratch(spark, "t").root)
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(30)] + [(31, None), (32, "y" * 5000)], "doc_id long, text string")
    commit, store.commit = store.commit, lambda *a: 1 / 0
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            store.append(docs, 500)
    store.commit = commit
    store.append(docs, 500)
    store.commit = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.compact(2000, 500)
    store.commit = commit
    assert store.compact(2000, 500) == 2
    assert sorted(r.doc_id for r in store.read().collect()) == [*range(30), 31, 32]


def test_old_versions_are_read_until_vacuum_drops_them(spark):
    store = sharding.ShardStore(spark, Scratch(spark, "t").root)
    store.append(spark.createDataFrame([(k, "x" * 100) for k in range(30)], "doc_id long, text string"), 500)
    store.compact(2000, 500)
    store.vacuum()
    assert {r.doc_id for r in store.read(1).collect()} == {r.doc_id for r in store.read(2).collect()} == set(range(30))
    store.vacuum(1, 0)
    assert store._versions() == [2] and store.read().count() == 30
    with pytest.raises(Exception, match="v1"):
        store.read(1).count()


def test_empty(spark):
    store = sharding.shard(spark.createDataFrame([], "doc_id long, text string"))
    assert store.read().count() == 0
