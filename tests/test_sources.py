import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import ConflictError, RecoveryRequiredError, Repository
from tidemark.functions import below, hive_folder, partition_value
from tidemark.operators import changed, deleted, obsolete, pruned, published, restored
from tidemark.plans.faults import Stopped, stopping
from tidemark.sources import datasets_frame, inventory, numbered, publish, read, refresh, rollback, spread, stage_frame, state_frame, steady
from tidemark.sources import datasource
from tidemark.streaming import sink


@pytest.fixture
def repository(tmp_path):
    r = Repository(tmp_path / "repository")
    r.initialize()
    return r


@pytest.fixture
def market(repository, tmp_path):
    return repository.create_dataset("market", tmp_path / "market")


def prices(spark, *rows):
    return spark.createDataFrame([(datetime.date(2026, 10, d), p) for d, p in rows], "date date, price long")


def put(spark, dataset, frame, n, **more):
    return publish(spark, dataset, frame, metadata={"n": n}, quiescent=True, partition_by=["date"], **more)


def listed(frame):
    return [(r.date.day, r.price) for r in frame.orderBy("date", "price").collect()]


def test_publish_revise_roll_back(spark, market):
    put(spark, market, prices(spark, (1, 1), (2, 2)), 1)
    assert sorted(p.name for p in (market.root / "date=2026-10-01").iterdir()) == ["data.parquet"]
    put(spark, market, prices(spark, (1, 99)), 2)
    assert listed(read(spark, market)) == [(1, 99), (2, 2)]
    assert listed(read(spark, market, "date=*/data.parquet").where(F.col("date") == "2026-10-02")) == [(2, 2)]
    market.rollback(quiescent=True)
    refresh(spark, market)
    assert listed(read(spark, market)) == [(1, 1), (2, 2)]


def test_a_cached_frame_does_not_hide_a_replacement(spark, market):
    put(spark, market, prices(spark, (1, 1)), 1)
    kept = read(spark, market).cache()
    assert listed(kept) == [(1, 1)]
    put(spark, market, prices(spark, (1, 5)), 2)
    assert listed(read(spark, market)) == [(1, 5)]
    kept.unpersist()


def test_reading_nothing(spark, market):
    with pytest.raises(FileNotFoundError):
        read(spark, market)
    assert read(spark, market, schema="price long, date date").count() == 0
    put(spark, market, prices(spark, (1, 1)), 1)
    assert read(spark, market, "date=2027*", schema="price long, date date").count() == 0
    market.rollback(quiescent=True)
    assert read(spark, market, schema="price long, date date").count() == 0


def test_one_file_for_each_partition_or_as_many_as_asked(spark, market):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(6)
    with market.write() as batch:
        assert sorted(stage_frame(batch, frame, ["k"])) == [f"k={i}/data.parquet" for i in range(3)]
        assert len(stage_frame(batch, frame.where("k = 0").drop("k"), file="hot", files=4)) == 4
        assert stage_frame(batch, frame.drop("k").limit(5), file="one", format="csv") == ["one.csv"]
        batch.commit(metadata={}, quiescent=True)
    hot = spark.read.parquet(str(market.root / "hot-*.parquet"))
    assert hot.count() == 334 and read(spark, market, "k=*").count() == 1000
    assert not list(market.root.rglob("*.crc")) + list(market.root.rglob("_SUCCESS"))


def test_escaped_and_hidden_partitions(spark, market):
    frame = spark.createDataFrame([("a:b/c", 1), ("x y", 2)], "k string, v int")
    publish(spark, market, frame, metadata={}, quiescent=True, partition_by=["k"])
    assert sorted((r.k, r.v) for r in read(spark, market).collect()) == [("a:b/c", 1), ("x y", 2)]
    names = inventory(spark, market).select(partition_value(F.col("path"), "k").alias("k")).collect()
    assert sorted(r.k for r in names) == ["a:b/c", "x y"]


def test_two_frames_for_one_path(spark, market):
    with market.write() as batch:
        stage_frame(batch, prices(spark, (1, 1)), ["date"])
        with pytest.raises(ValueError):
            stage_frame(batch, prices(spark, (1, 2)), ["date"])


def test_readers_are_refused_while_files_move(spark, market):
    put(spark, market, prices(spark, (1, 1)), 1)
    with pytest.raises(Stopped), stopping(2, only="replace"):
        put(spark, market, prices(spark, (1, 2)), 2)
    with pytest.raises(RecoveryRequiredError):
        read(spark, market)
    market.recover(quiescent=True)
    with steady(market):
        assert listed(read(spark, market)) == [(1, 1)]
    with pytest.raises(ConflictError), steady(market):
        put(spark, market, prices(spark, (1, 3)), 3)


def test_state_and_names_as_frames(spark, repository, market):
    assert [r.name for r in datasets_frame(spark, repository).collect()] == ["market"]
    row = state_frame(spark, market).first()
    assert (row.revision, row.operation, row.metadata) == (0, None, "{}")


def test_operators_do_what_the_control_plane_does(spark, market):
    def now():
        return {r.path: r.length for r in inventory(spark, market).collect()}

    def frame(d):
        return spark.createDataFrame(list(d.items()), "path string, length long")

    def write(files, delete=()):
        with market.write() as b:
            for p, n in files.items():
                b.stage(p).write_bytes(b"x" * n)
            for p in delete:
                b.delete(p)
            b.commit(metadata={"files": files}, quiescent=True)

    as_dict = lambda df: {r.path: r.length for r in df.collect()}
    write({"a": 1, "d/b": 2, "d/e/c": 3, "dd": 4})
    base = now()
    staged, gone = {"a": 10, "n": 5}, ["dd"]
    write(staged, gone)
    after = now()
    assert after == as_dict(published(frame(base), frame(staged), frame(dict.fromkeys(gone, 0))))
    assert as_dict(deleted(frame(base), frame({"a": 0}))) == {p: n for p, n in base.items() if p != "a"}
    assert {(r.path, r.change) for r in changed(frame(base), frame(after), "length").collect()} == {("a", "replaced"), ("n", "added"), ("dd", "deleted")}
    touched = {"a": 1, "dd": 4}
    assert as_dict(restored(frame(after), frame({"a": 0, "n": 0, "dd": 0}), frame(touched))) == base
    market.rollback(quiescent=True)
    assert now() == base
    with market.prune(quiescent=True) as b:
        b.delete("d")
        b.commit(metadata={})
    assert now() == as_dict(pruned(frame(base), ["d"])) == {"a": 1, "dd": 4}


def test_small_functions(spark):
    df = spark.createDataFrame([("a/b",), ("a",), ("ab",), ("k=1%2B2/l=x/f",)], "path string")
    got = df.select("path", below(F.col("path"), ["a"]).alias("b"), partition_value(F.col("path"), "k").alias("k")).collect()
    assert [(r.b, r.k) for r in got] == [(True, None), (True, None), (False, None), (False, "1+2")]
    assert spark.createDataFrame([(1, "x")], "a int, b string").select(hive_folder("a", "b").alias("h")).first().h == "a=1/b=x"
    work = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    assert [r.id for r in obsolete(work, "b").collect()] == ["a", "c"] and obsolete(work, None).count() == 3


def test_data_source(spark, market):
    datasource.register(spark)
    options = {"path": str(market.root), "name": "market"}
    frame = spark.range(100).select("id", F.col("id").cast("string").alias("s")).repartition(3)
    frame.write.format("tidemark").options(**options, file="part", metadata='{"n": 1}', quiescent="true").mode("append").save()
    assert market.current().metadata == {"n": 1} and market.work() == [market.current().undo]
    got = spark.read.format("tidemark").options(**options).load()
    assert sorted((r.id, r.s) for r in got.collect()) == [(i, str(i)) for i in range(100)]
    market.rollback(quiescent=True)
    bad = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error("stop").cast("long")).alias("id")).repartition(2)
    with pytest.raises(Exception, match="stop"):
        bad.write.format("tidemark").options(**options, quiescent="true").mode("append").save()
    assert market.current().revision == 2 and inventory(spark, market).count() == 0


def test_data_source_prunes_partitions(spark, market):
    datasource.register(spark)
    put(spark, market, prices(spark, (1, 1), (2, 2), (3, 3)), 1)
    source = spark.read.format("tidemark").options(path=str(market.root), name="market")
    every = source.load()
    assert [(r.price, r.date) for r in every.where("date = '2026-10-02'").collect()] == [(2, "2026-10-02")]
    assert every.count() == 3  # the same frame after a filtered scan
    got = source.option("only", '{"date": "2026-10-02"}').load()
    assert [(r.price, r.date) for r in got.collect()] == [(2, "2026-10-02")] and got.rdd.getNumPartitions() == 1
    assert source.option("only", '{"date": null}').load().count() == 0


def test_data_source_reads_null_partitions_and_later_columns(spark, market):
    datasource.register(spark)
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b=c")], "v long, k string")
    publish(spark, market, rows, metadata={}, quiescent=True, partition_by=["k"])
    publish(spark, market, spark.createDataFrame([(4, "z", 0.5)], "v long, k string, w double"), metadata={}, quiescent=True, partition_by=["k"])
    options = {"path": str(market.root), "name": "market"}
    got = spark.read.format("tidemark").options(**options).load()
    assert sorted((r.v, r.k, r.w) for r in got.collect()) == [(1, "a", None), (2, None, None), (3, "b=c", None), (4, "z", 0.5)]
    assert [r.v for r in got.where("k is null").collect()] == [2] and [r.v for r in got.where("k = 'b=c'").collect()] == [3]
    plain = read(spark, market, mergeSchema="true")
    assert sorted(map(tuple, plain.select("v", "k", "w").collect())) == sorted(map(tuple, got.select("v", "k", "w").collect()))
    (market.root / "odd.parquet").write_bytes((market.root / "k=a" / "data.parquet").read_bytes())
    with pytest.raises(Exception, match="partition columns"):
        spark.read.format("tidemark").options(**options).load()


def test_copies_by_tasks(spark, market):
    """Publishing and undoing with copies that Spark's tasks make."""
    spread(spark, market, least=1)
    put(spark, market, prices(spark, (1, 1), (2, 2), (3, 3)), 1)
    put(spark, market, prices(spark, (2, 20), (3, 30), (4, 40)), 2)
    kept = market.control / "work" / market.current().undo / "before"
    assert len(list(kept.rglob("*.parquet"))) == 2
    rollback(spark, market, quiescent=True)
    assert listed(read(spark, market)) == [(1, 1), (2, 2), (3, 3)]
    assert all(p.stat().st_nlink == 1 for p in market.root.rglob("*.parquet"))


def test_numbered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7).orderBy("x")
    got = numbered(df).collect()
    assert sorted((r.x, r.place) for r in got) == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0)).count() == 0


def test_streaming_sink(spark, market, tmp_path):
    source = str(tmp_path / "in")
    prices(spark, (1, 1), (2, 2)).write.parquet(source)
    stream = spark.readStream.schema("date date, price long").parquet(source)
    with pytest.raises(ValueError):
        sink(market, ["date"], quiescent=False)
    add = sink(market, ["date"], quiescent=True)

    def run(checkpoint="c"):
        q = stream.writeStream.foreachBatch(add).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return str(q.id)

    own = run()
    prices(spark, (2, 3)).write.mode("append").parquet(source)
    assert run() == own
    assert listed(read(spark, market)) == [(1, 1), (2, 2), (2, 3)] and market.current().revision == 2
    again = sink(market, ["date"], query=own, quiescent=True)
    again(prices(spark, (5, 5)), market.current().metadata["batches"][own])  # delivered again
    assert market.current().revision == 2
    # Another checkpoint is another stream: its batches count anew, and nothing of them is lost.
    other = run("d")
    assert other != own and market.current().metadata["batches"].keys() == {own, other}
    assert listed(read(spark, market)) == [(1, 1), (1, 1), (2, 2), (2, 2), (2, 3), (2, 3)]
