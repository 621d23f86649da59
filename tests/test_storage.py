"""Archives that split, tables with a commit log, streams into them, and the bucketed cache."""

import io
import os
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators.cache import Cache
from curata.sources import archives, commits
from curata.streaming import committed


def make_zip(path, n=40, size=3000, method=zipfile.ZIP_STORED):
    rng = np.random.default_rng(1)
    held = {f"d{k % 3}/f{k:03d}.{'png' if k % 2 else 'txt'}": rng.bytes(size) for k in range(n)}
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("d0/", b"")
        for name, data in held.items():
            z.writestr(name, data)
    return held


class Counting(io.FileIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        Counting.read_bytes += len(data or b"")
        return data


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_zip_splits(spark, tmp_path, method):
    held = make_zip(tmp_path / "a.zip", method=method)
    rows = archives.read_zip(spark, str(tmp_path), rangeBytes=20_000)
    assert rows.rdd.getNumPartitions() > 4  # one archive, several tasks
    assert {r["member"]: bytes(r["content"]) for r in rows.collect()} == held
    some = archives.read_zip(spark, f"file://{tmp_path}/a.zip", suffixes=(".png",), contains=("d1/",))
    assert {r["member"] for r in some.collect()} == {n for n in held if n.endswith(".png") and "d1/" in n}
    names = archives.read_zip(spark, str(tmp_path / "a.zip"), content=False).collect()
    assert len(names) == 40 and all(r["content"] is None and r["length"] == 3000 for r in names)


def test_zip_members_in_parts(spark, tmp_path):
    held = make_zip(tmp_path / "a.zip", n=2, size=10_000, method=zipfile.ZIP_DEFLATED)
    rows = archives.read_zip(spark, str(tmp_path / "a.zip"), partBytes=3000).orderBy("member", "part").collect()
    assert [r["part"] for r in rows] == [0, 1, 2, 3] * 2
    for name, data in held.items():
        assert b"".join(bytes(r["content"]) for r in rows if r["member"] == name) == data


def test_only_chosen_bytes_are_read(tmp_path, monkeypatch):
    make_zip(tmp_path / "a.zip", n=400, size=20_000)
    monkeypatch.setattr(archives, "opened", lambda path: Counting(path, "rb"))
    Counting.read_bytes = 0
    reader = archives.ZipReader({"path": str(tmp_path / "a.zip"), "contains": "f007", "rangeBytes": "1000"})
    (part,) = reader.partitions()
    directory = Counting.read_bytes
    assert directory < 100_000 < os.path.getsize(tmp_path / "a.zip") / 50
    Counting.read_bytes = 0
    assert sum(b.num_rows for b in reader.read(part)) == 1
    assert 20_000 <= Counting.read_bytes < 21_000


def test_damaged_member(spark, tmp_path):
    make_zip(tmp_path / "a.zip", n=3)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[200] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        archives.read_zip(spark, str(tmp_path / "a.zip")).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_scores(spark, tmp_path, save):
    n = 1000
    arrays = {"labels": np.arange(n) % 2, "paths": np.array([f"p{k}é" for k in range(n)]), "score_clean": np.linspace(0, 1, n), "score_jpeg": np.linspace(1, 0, n).astype(np.float32)}
    save(tmp_path / "s.npz", **arrays)
    rows = archives.read_scores(spark, str(tmp_path / "s.npz"), rows=300)
    assert rows.rdd.getNumPartitions() == (8 if save is np.savez else 2)
    got = {(r["cond"], r["row"]): r for r in rows.collect()}
    assert len(got) == 2 * n and all(got["jpeg", k]["score"] == float(arrays["score_jpeg"][k]) and got["clean", k]["path"] == f"p{k}é" and got["clean", k]["label"] == k % 2 and got["clean", k]["generator"] == "" for k in range(n))
    assert archives.read_scores(spark, str(tmp_path / "s.npz"), conditions=("jpeg",)).select("cond").distinct().count() == 1


def test_npz_reads_only_the_range(tmp_path, monkeypatch):
    n = 200_000
    np.savez(tmp_path / "s.npz", labels=np.zeros(n, np.int32), score_a=np.zeros(n), score_b=np.zeros(n))
    monkeypatch.setattr(archives, "opened", lambda path: Counting(path, "rb"))
    reader = archives.NpzReader({"path": str(tmp_path / "s.npz"), "conditions": "b", "rows": "1000"})
    parts = reader.partitions()
    assert len(parts) == 200
    Counting.read_bytes = 0
    assert sum(b.num_rows for b in reader.read(parts[77])) == 1000
    assert Counting.read_bytes < 1000 * 12 + 20_000


def rows_of(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


def test_commits(spark, tmp_path):
    table = commits.Table(spark, str(tmp_path / "t"))
    assert table.log() == [] and table.read(rows_of(spark, 1).schema).count() == 0
    assert commits.append_new(rows_of(spark, 1, 2, 2), str(tmp_path / "t"), ["id"]) == 0
    assert commits.append_new(rows_of(spark, 2, 3), str(tmp_path / "t"), ["id"]) == 1
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3]
    assert [r["id"] for r in commits.missing(rows_of(spark, 3, 4), str(tmp_path / "t"), ["id"]).collect()] == [4]
    assert table.append(rows_of(spark, 9), batch="b") == 2 and table.append(rows_of(spark, 9), batch="b") is None
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3, 9]


def test_writer_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    table = commits.Table(spark, str(tmp_path / "t"))
    table.append(rows_of(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(commits.Table, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.append(rows_of(spark, 2, 3), ["id"])
    assert [r["id"] for r in table.read().collect()] == [1]
    assert table.append(rows_of(spark, 2, 3), ["id"]) == 1
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3]
    assert len(table.vacuum(0)) == 1 and table.read().count() == 3 and table.vacuum(0) == []


def test_two_writers_at_once(spark, tmp_path):
    """Both look at the same state, both write, one commits first: no key is there twice, none is lost."""
    path = str(tmp_path / "t")
    commits.Table(spark, path).append(rows_of(spark, 0))
    gate = threading.Barrier(3)

    class Slow(commits.Table):
        waited = False

        def publish(self, *a):
            if not self.waited:
                self.waited = True
                gate.wait(60)
            super().publish(*a)

    tables = [Slow(spark, path) for _ in range(3)]
    threads = [threading.Thread(target=t.append, args=(rows_of(spark, *ids), ["id"])) for t, ids in zip(tables, [(1, 2, 3), (2, 3, 4), (0, 3, 5)])]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    table = commits.Table(spark, path)
    assert sorted(r["id"] for r in table.read().collect()) == [0, 1, 2, 3, 4, 5]
    assert [c.number for c in table.log()] == [0, 1, 2, 3]


def test_same_batch_by_two_writers(spark, tmp_path):
    one, two = (commits.Table(spark, str(tmp_path / "t")) for _ in range(2))
    two.log()
    one.append(rows_of(spark, 1), batch="x")
    assert two.append(rows_of(spark, 1), batch="x") is None and two.read().count() == 1


def test_stream_restarts_between_write_and_commit(spark, tmp_path, monkeypatch):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = rows_of(spark, 1).schema
    rows_of(spark, 1, 2).coalesce(1).write.parquet(source)

    def run():
        committed.write_committed(committed.read_folder(spark, source, schema, files=1), target, state, "s", ["id"]).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(commits.Table, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash before the commit")))
        with pytest.raises(Exception, match="crash"):
            run()
    assert commits.Table(spark, target).log() == []
    rows_of(spark, 2, 3).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in commits.Table(spark, target).read().collect()) == [1, 2, 3]

    def crash(rows, number):
        raise RuntimeError("crash behind the commit")

    rows_of(spark, 4).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="crash"):
        committed.write_committed(committed.read_folder(spark, source, schema, files=1), target, state, "s", None, crash).awaitTermination()
    run()  # the batch runs again, and its commit is there
    assert sorted(r["id"] for r in commits.Table(spark, target).read().collect()) == [1, 2, 3, 4]


def test_first_rows_and_late_ones(spark, tmp_path):
    source = str(tmp_path / "in")
    make = lambda rows: spark.createDataFrame(rows, "id long, v string, t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    from datetime import datetime

    at = lambda k: datetime(2024, 1, 1, 0, k)
    make([(1, "b", at(2)), (1, "a", at(1)), (2, "c", at(3))]).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        run = lambda: committed.write_first(committed.read_folder(spark, source, schema), "id", "t", str(tmp_path / "first"), str(tmp_path / "late"), str(tmp_path / "state"), "f").awaitTermination()
        run()
        make([(1, "d", at(0)), (3, "e", at(4))]).coalesce(1).write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    values = lambda name: sorted(r["v"] for r in commits.Table(spark, str(tmp_path / name)).read().collect())
    assert values("first") == ["a", "c", "e"] and values("late") == ["b", "d"]


def test_cache_computes_once_and_joins_in_place(spark, tmp_path):
    cache = Cache(spark, "embedding_cache", str(tmp_path / "cache"), "key", 4)
    computed = spark.sparkContext.accumulator(0)

    def compute(rows):
        @F.udf("array<double>")
        def embed(k):
            computed.add(1)
            return [float(k), 1.0]

        return rows.select("key", embed("key").alias("embedding"))

    try:
        first = cache.inputs(spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 7).alias("x")), "embedding_inputs")
        assert cache.fill(first, compute, shards=3) == 100 and computed.value == 100
        assert cache.fill(first, compute, shards=3) == 0 and computed.value == 100
        more = cache.inputs(spark.range(50, 130).select(F.col("id").alias("key"), (F.col("id") % 7).alias("x")), "more_inputs")
        assert cache.fill(more, compute) == 30 and computed.value == 130
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = cache.joined(spark.table("more_inputs"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
        assert {r["key"]: r["embedding"][0] for r in joined.collect()} == {k: float(k) for k in range(50, 130)}
        left = cache.missing(spark.table("more_inputs"))
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString() and left.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("embedding_cache", "embedding_inputs", "more_inputs"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
