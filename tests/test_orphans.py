from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import orphans

T = lambda d, h=0: datetime(2022, 1, d, h)
FK = "fk_id bigint, database_name string, from_table string, to_table string, to_column string, collected_at timestamp, source_table int"
VDS = "vds_id bigint, database_name string, coretable string, collected_at timestamp"
CAT = "column_id bigint, database_name string, table_name string, column_name string, first_seen_at timestamp, dropped_at timestamp"


def found(spark, fk, vds, cat):
    refs = orphans.references(spark.createDataFrame(fk, FK), spark.createDataFrame(vds, VDS))
    return {(r["source_table"], r["record_id"]) for r in orphans.by_period(refs, orphans.parents(spark.createDataFrame(cat, CAT)), 12).references().where("is_orphan").collect()}


@pytest.mark.parametrize("raw, want", [("public.Orders", "orders"), ("[dbo].[ Orders ]", "orders"), ('"a.b"', "a.b"), ("  ", None), (None, None), ("`s`.`t`", "t"), ("a.b.c", "c")])
def test_identifier(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(orphans.identifier("x")).first()[0]
    assert got == want


def test_probe_at_the_edges_of_a_life(spark):
    cat = [(1, "d", "T", "id", T(2), T(5)), (1, "d", "T", "id", T(2), T(5)), (2, "d", "T", "x", T(2), None)]
    fk = [(i, "d", "a", "t", c, at, 1) for i, (c, at) in enumerate([("id", T(2)), ("id", T(5)), ("id", T(1)), ("x", T(9)), ("", T(5)), (None, T(1)), ("y", T(3))])]
    assert found(spark, fk, [], cat) == {("foreign_keys", 1), ("foreign_keys", 2), ("foreign_keys", 5), ("foreign_keys", 6)}


def test_nulls_and_empty_tables(spark):
    fk = [(1, None, "a", "t", None, T(3), 1), (2, "d", "a", None, None, T(3), 1), (3, "d", "a", "t", None, None, 1)]
    cat = [(1, "d", "t", None, None, None)]
    assert found(spark, fk, [(9, "d", "T", T(3))], cat) == {("foreign_keys", 1), ("foreign_keys", 3)}
    assert found(spark, fk, [], []) == {("foreign_keys", 1), ("foreign_keys", 3)}
    assert found(spark, [], [], cat) == set()


EVENTS = "key string, at bigint, turn int, delta int, source_table string, record_id bigint"


def changed(store, rows, batch):
    return sorted((r["record_id"], r["change"]) for r in store.advance(store.spark.createDataFrame(rows, EVENTS), batch).collect())


def test_batches_resolve_and_reopen(spark, tmp_path):
    store = orphans.OrphanStore(spark, str(tmp_path / "s"))
    assert changed(store, [("k", 1, 1, 0, "f", 1)], 1) == [(1, "orphan")]
    assert changed(store, [("k", 2, 0, 1, None, None), ("k", 3, 1, 0, "f", 2)], 2) == [(1, "resolved")]
    assert changed(store, [("k", 4, 0, -1, None, None)], 3) == [(1, "reopened"), (2, "reopened")]
    assert sorted(r["record_id"] for r in store.waiting().collect()) == [1, 2]
    assert changed(store, [("q", 5, 1, 0, "f", 3), ("q", 6, 0, 1, None, None)], 4) == [(3, "orphan"), (3, "resolved")]
    assert changed(store, [], 5) == []


def test_restart_repeats_and_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = [("k", 1, 1, 0, "f", 1)], [("k", 2, 0, 1, None, None), ("k", 3, 1, 0, "f", 2)]
    store = orphans.OrphanStore(spark, path)
    changed(store, one, 0)
    store.spark.createDataFrame([("k", 9, 9, 0, 0, 1)], store._INDEX).write.parquet(f"{path}/index-1")  # a run that died before the pointer moved
    again = orphans.OrphanStore(spark, path)
    assert changed(again, two, 1) == [(1, "resolved")]
    assert changed(again, two, 1) == [(1, "resolved")]  # delivered again: applied once
    assert [tuple(r) for r in again.index().collect()] == [("k", 1, 2, 0)] and again.references().count() == 2


def test_only_touched_keys_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(orphans.OrphanStore, "MERGED", 3)
    store = orphans.OrphanStore(spark, str(tmp_path / "s"))
    changed(store, [(f"k{i}", 1, 1, 0, "f", i) for i in range(50)], 1)
    for b in range(2, 7):
        changed(store, [(f"k{b}", b, 0, 1, None, None)], b)
        assert spark.read.parquet(f"{store.path}/index-{b}").count() == 1
    assert len(store.pointer.get()["index"]) <= 3 and store.index().count() == 50 and store.waiting().count() == 45


def test_periods_agree_with_one_replay(spark):
    import random

    r = random.Random(3)
    at = lambda: datetime(2022, r.randint(1, 5), r.randint(1, 28), r.randint(0, 3))
    cat = [(i, "d", r.choice("abc"), r.choice("xy"), r.choice([None, at()]), r.choice([None, at()])) for i in range(30)]
    fk = [(i, r.choice(["d", None]), "z", r.choice("abcq"), r.choice(["x", "y", None]), r.choice([None, at(), at(), at()]), 1) for i in range(80)]
    refs, spans = orphans.references(spark.createDataFrame(fk, FK), spark.createDataFrame([], VDS)), orphans.parents(spark.createDataFrame(cat, CAT))
    want = {(x["record_id"], x["is_orphan"]) for x in orphans.probe(refs, spans).collect()}
    for months in (1, 4):
        assert {(x["record_id"], x["is_orphan"]) for x in orphans.by_period(refs, spans, months).references().collect()} == want
    assert orphans.by_period(refs.limit(0), spans.limit(0)).references().count() == 0


def test_stream_survives_a_restart(spark, tmp_path):
    from lodeweave.streaming.ingest import track_orphans

    def run(rows, name):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        got = []
        q = track_orphans(spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), orphans.OrphanStore(spark, f"{tmp_path}/state"), lambda c, b: got.extend(sorted((r["record_id"], r["change"]) for r in c.collect())), f"{tmp_path}/checkpoint")
        q.processAllAvailable()
        q.stop()
        return got

    assert run([("k", 1, 1, 0, "f", 1)], "a") == [(1, "orphan")]
    assert run([("k", 2, 0, 1, None, None)], "b") == [(1, "resolved")]


def test_counts_per_month(spark):
    refs = orphans.references(spark.createDataFrame([(1, "d", "a", "t", None, T(3), 1), (2, "d", "a", "T", None, T(4), 1)], FK), spark.createDataFrame([], VDS))
    row = orphans.snapshot_counts(orphans.probe(refs, orphans.parents(spark.createDataFrame([(1, "d", "t", "c", T(4), None)], CAT)))).first()
    assert (row["db"], row["tab"], row["month"], row["n_references"], row["n_orphans"]) == ("d", "t", "2022-01", 2, 1)
    assert refs.where(F.col("col").isNotNull()).count() == 0
