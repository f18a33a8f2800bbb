"""The versioned table: literal cases, a model test, crashes and snapshots."""

from __future__ import annotations

import random

import pytest

from tidemark.schema import DELETE, PUT
from tidemark.sources import manifest as M
from tidemark.sources.files import Files
from tidemark.sources.kvtable import KVTable, Options, TableError


def keys(df):
    return [r["key"] for r in df.collect()]


@pytest.fixture
def table(spark, tmp_path):
    return KVTable.open(spark, str(tmp_path / "t"))


def test_point_reads(table):
    assert table.get("missing") == (False, None)
    table.put("k", "v1")
    table.put("k", "v2")
    assert table.get("k") == (True, "v2")
    table.delete("k")
    assert table.get("k") == (False, None)
    table.delete("never")
    table.put("k", "")
    assert table.get("k") == (True, "")
    table.put("n", None)
    assert table.get("n") == (True, None)


def test_scan_merges_tail_and_segments(table):
    table.write([(PUT, k, k) for k in "aceg"])
    table.flush()
    table.write([(PUT, k, k) for k in "bdf"] + [(DELETE, "c", None), (PUT, "a", "new")])
    assert keys(table.scan("a", "g")) == list("abdefg")
    assert keys(table.scan("b", "d")) == ["b", "d"]
    assert keys(table.scan("d", "b")) == []
    assert keys(table.scan("x", "z")) == []
    assert table.get("a") == (True, "new")


def test_model(spark, tmp_path):
    """Random operations against a dict, with flushes, compactions and reopening."""
    rnd, model, path = random.Random(7), {}, str(tmp_path / "m")
    options = Options(flush_threshold=6, compaction_threshold=3)
    t = KVTable.open(spark, path, options)
    for step in range(60):
        act, k = rnd.random(), f"key{rnd.randrange(16):02d}"
        if act < 0.6:
            t.put(k, str(step))
            model[k] = str(step)
        elif act < 0.8:
            t.delete(k)
            model.pop(k, None)
        elif act < 0.88:
            t.flush()
        elif act < 0.94:
            t.compact()
        else:
            t = KVTable.open(spark, path, options)
        if step % 10 == 9:
            assert {r["key"]: r["value"] for r in t.scan("", "zzz").collect()} == model
            assert t.get(k) == (k in model, model.get(k))
    t.flush()
    t.compact()
    assert len(t.manifest.segments) <= 1
    assert {r["key"]: r["value"] for r in t.live().collect()} == model
    t.vacuum()
    assert {r["key"]: r["value"] for r in KVTable.open(spark, path).live().collect()} == model


def test_hot_keys_stay_bounded(spark, tmp_path):
    from tidemark.sources.kvtable import LOGGED

    path = str(tmp_path / "h")
    t = KVTable.open(spark, path, Options(flush_threshold=3))
    for i in range(9):
        t.put(f"k{i % 2}", str(i))
    assert not t.manifest.segments and len(t.tail) == 2 and t.records == 9
    again = KVTable.open(spark, path, Options(flush_threshold=3))
    assert again.tail == t.tail and again.last_seq == 9 and again.get("k0") == (True, "8")
    t.write([(PUT, "k1", str(i)) for i in range(3 * LOGGED)])
    assert len(t.manifest.segments) == 1 and not t.tail and not t.logged
    assert KVTable.open(spark, path).get("k1") == (True, str(3 * LOGGED - 1))


def test_two_writers_of_one_name(spark, tmp_path):
    """Whoever comes second fails, and what the first one wrote stays; temporary files are gone."""
    a, b = Files(spark, str(tmp_path / "w")), Files(spark, str(tmp_path / "w"))
    a.mkdirs()
    a.write_new("x", b"first")
    with pytest.raises(FileExistsError):
        b.write_new("x", b"second")
    assert a.read("x") == b"first" and b.names() == ["x"]
    from concurrent.futures import ThreadPoolExecutor

    def race(k):
        won = []
        for i in range(20):
            try:
                (a, b)[k].write_new(f"n{i}", bytes([k]))
                won.append(i)
            except FileExistsError:
                pass
        return won

    with ThreadPoolExecutor(2) as pool:
        won = list(pool.map(race, (0, 1)))
    assert sorted(won[0] + won[1]) == list(range(20))
    assert all(a.read(f"n{i}") == bytes([k]) for k in (0, 1) for i in won[k])


def test_interleaved_writers_do_not_mix(spark, tmp_path):
    path = str(tmp_path / "i")
    one, two = KVTable.open(spark, path), KVTable.open(spark, path)
    one.put("a", "1")
    with pytest.raises(FileExistsError):
        two.put("b", "2")
    one.flush()
    with pytest.raises(FileExistsError):
        two.append(spark.createDataFrame([("c", "3", PUT, 1)], "key string, value string, op int, place long"))
    assert {r["key"] for r in KVTable.open(spark, path).live().collect()} == {"a"}


def test_replica_batches(spark, tmp_path):
    path, mode = str(tmp_path / "r"), Options(replica=True)
    t = KVTable.open(spark, path, mode)
    with pytest.raises(TableError):
        t.put("a", "b")
    with pytest.raises(TableError):
        t.apply_batch(2, [])
    with pytest.raises(TableError):
        t.apply_batch(0, [])
    with pytest.raises(TableError):
        t.apply_batch(1, [(PUT, "a", "x"), (PUT, "", "y")])
    assert t.apply_batch(1, [(PUT, "a", "first"), (PUT, "a", "second")])
    assert t.get("a") == (True, "first")
    assert t.apply_batch(2, [(PUT, "a", "two")])
    assert not t.apply_batch(2, [(DELETE, "a", None)])
    assert t.apply_batch(3, [])
    assert t.get("a") == (True, "two") and t.applied_index == 3
    t.close()
    again = KVTable.open(spark, path, mode)
    assert again.applied_index == 3 and again.manifest.applied_index == 3


def test_crash_before_publish_keeps_the_old_generation(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    t = KVTable.open(spark, path)
    t.put("a", "1")
    monkeypatch.setattr(M, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.flush()
    monkeypatch.undo()
    t = KVTable.open(spark, path)
    assert t.get("a") == (True, "1") and not t.manifest.segments
    t.flush()
    assert t.get("a") == (True, "1") and len(t.manifest.segments) == 1


def test_two_writers_collide(spark, tmp_path):
    path = str(tmp_path / "w")
    a, b = KVTable.open(spark, path), KVTable.open(spark, path)
    a.put("x", "1")
    a.flush()
    b.last_seq = 1
    b.put("y", "2")
    with pytest.raises(FileExistsError):
        b.flush()


def test_snapshot_and_restore(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "s"), Options(replica=True))
    with pytest.raises(TableError):
        t.snapshot(str(tmp_path / "empty"))
    t.apply_batch(1, [(PUT, "a", "1"), (PUT, "b", "2")])
    t.apply_batch(2, [(DELETE, "a", None)])
    assert t.snapshot(str(tmp_path / "image")) == 2
    other = KVTable.open(spark, str(tmp_path / "o"), Options(replica=True))
    other.restore(str(tmp_path / "image"))
    assert keys(other.live()) == ["b"] and other.applied_index == 2
    assert other.apply_batch(3, [(PUT, "c", "3")])
    with pytest.raises(TableError):
        other.restore(str(tmp_path / "image"))


def test_append_numbers_on(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "b"))
    t.put("k0", "old")
    rows = spark.range(100).selectExpr("concat('k', id % 10) AS key", "cast(id AS string) AS value", "0 AS op", "id AS place")
    t.append(rows)
    assert t.last_seq == 101
    assert t.get("k0") == (True, "90")
    assert {r["key"]: r["value"] for r in t.multi_get(["k3", "k7", "none"]).collect()} == {"k3": "93", "k7": "97"}
    assert t.status().first()["segments"] == 2


@pytest.mark.parametrize("name", ["../x.parquet", "a/b.parquet", "seg.sst", "", "x.parquet/"])
def test_manifest_names(name):
    with pytest.raises(M.ManifestError):
        M.Manifest(segments=(M.Segment(name, "a", "b", 1, 1),)).validate()


def test_manifest_versions(spark, tmp_path):
    files = Files(spark, str(tmp_path / "v"))
    files.mkdirs()
    assert M.load(files) == M.Manifest()
    with pytest.raises(M.ManifestError):
        M.Manifest(version=9).validate()
    s = M.Segment("seg-1.parquet", "a", "b", 1, 5)
    with pytest.raises(M.ManifestError):
        M.Manifest(segments=(s, s)).validate()
    files.write_new("manifest-000000000001.json", b'{"generation": 1, "version": 1, "segments": [{"name": "seg-1.parquet", "min_key": "a", "max_key": "b", "records": 1, "max_seq": 5}], "next_id": 2, "applied_index": 0}')
    assert M.load(files).last_seq == 5


def test_passing_tables_go(spark, tmp_path):
    with KVTable.open(spark) as t:
        t.put("a", "1")
        t.flush()
        assert t.get("a") == (True, "1") and t.files.names()
    assert not t.files.names()
    with pytest.raises(TableError):
        t.get("k" * 20_000)


def test_bootstrap_from_segments(spark, tmp_path):
    path = str(tmp_path / "b")
    t = KVTable.open(spark, path)
    t.write([(PUT, "a", "1"), (PUT, "b", "2")])
    t.flush()
    t.write([(DELETE, "a", None), (PUT, "c", "3")])
    t.flush()
    for n in t.files.names():
        if n.startswith("manifest"):
            t.files.delete(n)
    again = KVTable.bootstrap(spark, path)
    assert sorted(keys(again.live())) == ["b", "c"] and again.last_seq == 4
    assert again.put("d", "4") == 5 and sorted(keys(KVTable.open(spark, path).live())) == ["b", "c", "d"]
    with pytest.raises(TableError):
        KVTable.bootstrap(spark, path)
