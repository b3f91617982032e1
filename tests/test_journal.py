"""The journal: every step can be the last one before a crash; claimants; streams; empty reads."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sinks.journal import Journal, Lost

SCHEMA = "id long, side string"


class Crash(Exception):
    pass


def tables(spark, n):
    rows = spark.range(n).select("id", F.lit("x").alias("side"))
    return {"data": rows, "index": rows.limit(1)}


def seen(log):
    return {name: sorted(tuple(r) for r in log.read(name, SCHEMA).collect()) for name in ("data", "index")}


@pytest.mark.parametrize("at", ("claim", "stage", "halfway", "intend", "torn", "publish", "moved", "finish", "marked"))
def test_every_step_can_be_the_last(spark, tmp_path, monkeypatch, at):
    """Killed after (or within) a step, a batch shows nothing; recovery finishes or undoes it, and the batch can be written or is done."""
    log = Journal(spark, str(tmp_path))
    log.write("b0", tables(spark, 2))
    before = seen(log)

    def fail(*_):
        raise Crash

    if at in ("claim", "stage", "intend", "publish"):
        whole = getattr(Journal, at)
        monkeypatch.setattr(Journal, at, lambda self, *a: (whole(self, *a), fail()))
    elif at == "halfway":
        monkeypatch.setattr(Journal, "stage", lambda self, b, o, t: (next(iter(t.values())).write.parquet(f"{self.path}/staged/{b}/{o}/data"), fail()))
    elif at == "torn":
        monkeypatch.setattr(Journal, "intend", lambda self, b, o, t: (self._make('{"batch": "b1", "own', "intents", b), fail()))
    elif at == "moved":  # one table of two is in place
        def publish(self, b):
            todo = self.intent(b)
            fs, target = self._at("data", "data", f"batch={b}")
            fs.mkdirs(target.getParent())
            assert fs.rename(self._at("staged", b, todo["owner"], "data")[1], target)
            fail()
        monkeypatch.setattr(Journal, "publish", publish)
    elif at == "finish":
        monkeypatch.setattr(Journal, "finish", fail)
    else:
        monkeypatch.setattr(Journal, "finish", lambda self, b: (self._make(b, "done", b), fail()))
    with pytest.raises(Crash):
        log.write("b1", tables(spark, 3))
    monkeypatch.undo()

    happens = at in ("intend", "publish", "moved", "finish", "marked")
    if at != "marked":
        assert seen(log) == before
        with pytest.raises(Lost):
            log.write("b1", tables(spark, 3))  # the claim is still there
        assert log.recover(older_than=3600) == {}
    assert log.recover() == {"b1": "finished" if happens else "undone"}
    assert log.recover() == {}
    assert log.write("b1", tables(spark, 3)) is not happens
    assert seen(log) == {"data": sorted([*before["data"], *((i, "x", "b1") for i in range(3))]), "index": sorted([*before["index"], (0, "x", "b1")])}
    assert not log._names("claims") and not log._names("staged")


def test_one_of_two_claimants_wins(spark, tmp_path):
    log = Journal(spark, str(tmp_path))
    log.claim("b", "one")
    with pytest.raises(Lost):
        log.claim("b", "two")
    # One is slow and is held for dead; two takes over, and one loses at the intent.
    log.stage("b", "one", tables(spark, 1))
    assert log.recover() == {"b": "undone"}
    log.claim("b", "two")
    log.stage("b", "two", tables(spark, 2))
    with pytest.raises(Lost):
        log.intend("b", "one", ["data", "index"])
    log.intend("b", "two", ["data", "index"])
    with pytest.raises(Lost):
        log.intend("b", "two", ["data"])
    log.publish("b")
    log.publish("b")
    log.finish("b")
    assert len(seen(log)["data"]) == 2
    assert [tuple(r) for r in log.intents().collect()] == [("b", "two", ["data", "index"])]


def test_nothing_written_is_an_empty_table(spark, tmp_path):
    log = Journal(spark, str(tmp_path / "none"))
    assert log.read("data", SCHEMA).columns == ["id", "side", "batch"] and log.read("data", SCHEMA, latest=True).count() == 0
    assert log.done().count() == 0 and log.intents().count() == 0 and log.recover() == {}
    log.write("b", {"data": spark.range(0).select("id", F.lit("x").alias("side"))})
    assert log.read("data", SCHEMA).count() == 0 and log.done().count() == 1


def test_latest_state_and_pruned_folders(spark, tmp_path):
    log = Journal(spark, str(tmp_path))
    for n in range(3):
        log.write(f"b{n}", tables(spark, n + 1) if n < 2 else {"index": tables(spark, 9)["index"]})
    assert sorted(r.id for r in log.read("data", SCHEMA, latest=True).collect()) == [0, 1]
    assert [r.batch for r in log.read("index", SCHEMA, latest=True).collect()] == ["b2"]


def test_stream_batches_happen_once(spark, tmp_path, monkeypatch):
    """A micro-batch that fails after its intent is repeated by Spark after the restart, and is there once."""
    log = Journal(spark, str(tmp_path / "out"))
    source = str(tmp_path / "in")
    spark.range(4).select("id", F.lit("s").alias("side")).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return stream.writeStream.foreachBatch(log.sink(lambda df: {"data": df, "index": df.groupBy("side").agg(F.count("*").alias("id")).select("id", "side")})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    whole = Journal.publish

    def publish(self, batch):
        whole(self, batch)
        raise Crash

    monkeypatch.setattr(Journal, "publish", publish)
    with pytest.raises(Exception, match="Crash"):
        run().awaitTermination(120)
    monkeypatch.undo()
    assert seen(log) == {"data": [], "index": []}
    assert run().awaitTermination(120)
    name = f"{0:020d}"
    assert seen(log) == {"data": [(i, "s", name) for i in range(4)], "index": [(4, "s", name)]}
