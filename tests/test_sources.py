"""Raw files and streams."""

import os

import pytest

from cairnlog.model import KV_LOG, DataCorrupted
from cairnlog.operators.resolve import latest
from cairnlog.sources import rawlog
from cairnlog.streaming.latest import compacted, read_compacted, read_log


def rows(spark, path, kind="data", mode="truncate"):
    spark.dataSource.register(rawlog.RawLogSource)
    return spark.read.format("rawlog").option("path", str(path)).option("kind", kind).option("mode", mode).load()


def test_data_files(spark, tmp_path):
    good = [rawlog.encode_data(1, b"a", b"1"), rawlog.encode_data(2, b"b", b"22"), rawlog.encode_data(3, b"a", b"")]
    (tmp_path / "9.data").write_bytes(b"".join(good))
    (tmp_path / "10.data").write_bytes(good[0] + good[1][:-1] + b"X" + good[2])
    (tmp_path / "abc.data").write_bytes(good[0][:20])
    (tmp_path / "9.hint").write_bytes(rawlog.encode_hint(b"b", 2, 2, 58))
    got = rows(spark, tmp_path).orderBy("seq").collect()
    assert [(os.path.basename(r.file), bytes(r.key), bytes(r.value), r.deleted) for r in got] == [
        ("9.data", b"a", b"1", False), ("9.data", b"b", b"22", False), ("9.data", b"a", b"", True), ("10.data", b"a", b"1", False),
    ]
    newest = {bytes(r.key): r.tstamp for r in latest(rows(spark, tmp_path)).collect()}
    assert newest == {b"a": 1, b"b": 2}  # file order, then offset; never the time
    why = {(os.path.basename(r.file), r.pos): r.reason for r in rows(spark, tmp_path, mode="report").where("reason IS NOT NULL").collect()}
    assert why == {("10.data", 30): "CrcMismatch", ("abc.data", 0): "LengthMismatch"}
    with pytest.raises(Exception, match="CrcMismatch|LengthMismatch"):
        rows(spark, tmp_path, mode="failfast").collect()
    hint = rows(spark, tmp_path, "hint").first()
    assert (bytes(hint.key), hint.tstamp, hint.value_sz, hint.value_pos) == (b"b", 2, 2, 58)


def test_wal_files(spark, tmp_path):
    good = [rawlog.encode_wal(1, b"a", b"1"), rawlog.encode_wal(2, b"a", None), rawlog.encode_wal(3, b"b", b"")]
    (tmp_path / "1.wal").write_bytes(b"".join(good) + b"\x03" + bytes(40))
    got = rows(spark, tmp_path, "wal", "report").orderBy("pos").collect()
    assert [r.deleted for r in got] == [False, True, False, None] and got[3].reason == "UnknownTag"
    assert bytes(got[2].value) == b""
    (tmp_path / "2.wal").write_bytes(rawlog.encode_wal(1, b"k" * 16385, b""))
    assert rows(spark, tmp_path, "wal", "report").where("reason = 'KeyTooLong'").count() == 1


def test_write_and_read_back(spark, tmp_path):
    spark.dataSource.register(rawlog.RawLogSource)
    made = spark.range(500).selectExpr("cast(concat('k', id % 50) AS binary) AS key", "cast(repeat('v', cast(id AS int)) AS binary) AS value", "id % 9 = 0 AS deleted", "id AS tstamp")
    for kind in ("data", "wal"):
        out = tmp_path / kind
        made.write.format("rawlog").mode("append").option("path", str(out)).option("kind", kind).option("limit", 4096).save()
        back = rows(spark, out, kind, "failfast")
        assert back.count() == 500 and back.where("deleted").count() == made.where("deleted").count()
        sizes = [os.path.getsize(out / n) for n in os.listdir(out)]
        assert max(sizes) <= 4096 and all(not n.startswith(".") for n in os.listdir(out))


@pytest.mark.parametrize("kind", ["data", "hint", "wal"])
def test_appends_replace_nothing(spark, tmp_path, kind):
    spark.dataSource.register(rawlog.RawLogSource)
    for i in range(3):
        made = spark.range(4, numPartitions=2).selectExpr(
            f"cast(concat('k{i}-', id) AS binary) AS key", "cast('value' AS binary) AS value", "false AS deleted", f"{i}L AS tstamp", "5L AS value_sz", "id * 9 AS value_pos"
        )
        made.write.format("rawlog").mode("append").option("path", str(tmp_path)).option("kind", kind).save()
    back = rows(spark, tmp_path, kind, "failfast").collect()
    assert {bytes(r.key) for r in back} == {f"k{i}-{j}".encode() for i in range(3) for j in range(4)} and len(back) == 12
    assert [r.tstamp for r in sorted(back, key=lambda r: r.seq)] == sorted(r.tstamp for r in back)  # later files come later
    if kind == "hint":
        assert {(r.value_sz, r.value_pos) for r in back} == {(5, 9 * j) for j in range(4)}
    if kind != "hint":
        some = rawlog.read_files(spark, str(tmp_path), kind)
        assert sorted(map(str, some.select(*back[0].__fields__[2:]).collect())) == sorted(str(r) for r in spark.createDataFrame(back, some.schema).select(*back[0].__fields__[2:]).collect())
    for bad in ({"kind": "other"}, {}):
        with pytest.raises(Exception, match="no such kind|only ever appended"):
            made.write.format("rawlog").mode("append" if bad else "overwrite").options(path=str(tmp_path), **bad).save()
    with pytest.raises(Exception, match="no such kind"):
        rows(spark, tmp_path, "other").collect()


def folder_rows(spark, path):
    from cairnlog.sources import folder

    return {bytes(r.key): bytes(r.value) for r in folder.values_at(folder.opened(spark, str(path))).collect()}


def write_data(spark, path, ops, tstamp, hints=False):
    """One data file of puts, and of deletes for None."""
    made = spark.createDataFrame([(k.encode(), v and v.encode(), v is None, tstamp + i) for i, (k, v) in enumerate(ops)], "key binary, value binary, deleted boolean, tstamp long")
    made.coalesce(1).write.format("rawlog").mode("append").options(path=str(path), hints=str(hints).lower()).save()


def test_folder_is_opened_and_merged(spark, tmp_path):
    from cairnlog.sources import folder

    spark.dataSource.register(rawlog.RawLogSource)
    write_data(spark, tmp_path, [("ash", "1"), ("elm", "2"), ("oak", "3")], 10, hints=True)
    write_data(spark, tmp_path, [("ash", "4"), ("elm", None)], 20)
    write_data(spark, tmp_path, [("yew", "5"), ("oak", None)], 5)  # an earlier time in a later file still wins
    want = {b"ash": b"4", b"yew": b"5"}
    assert folder_rows(spark, tmp_path) == want
    # hints count where a stem has them: what they don't say isn't there
    (tmp_path / "1.hint").write_bytes(rawlog.encode_hint(b"ash", 20, 1, 31))
    assert folder_rows(spark, tmp_path) == {**want, b"elm": b"2"}
    os.remove(tmp_path / "1.hint")
    folder.merge(spark, str(tmp_path))
    assert folder_rows(spark, tmp_path) == want
    names = sorted(n for n in os.listdir(tmp_path) if not n.startswith("."))
    assert names == ["1.data", "1.hint", "2.data"] and (tmp_path / "1.data").stat().st_size == 28 + 3 + 1
    assert rows(spark, tmp_path, "hint").count() == 1
    write_data(spark, tmp_path, [("elm", "6"), ("ash", None)], 1)  # after a merge, and opened again
    assert folder_rows(spark, tmp_path) == {b"elm": b"6", b"yew": b"5"}
    folder.merge(spark, str(tmp_path))
    assert folder_rows(spark, tmp_path) == {b"elm": b"6", b"yew": b"5"}


def test_merge_looks_at_checksums_and_recovers(spark, tmp_path):
    import json

    from cairnlog.sources import folder

    write_data(spark, tmp_path, [("ash", "1")], 1)
    write_data(spark, tmp_path, [("elm", "2")], 2)
    whole = (tmp_path / "0.data").read_bytes()
    (tmp_path / "0.data").write_bytes(whole[:-1] + b"X")
    with pytest.raises(Exception, match="CrcMismatch"):
        folder.merge(spark, str(tmp_path))
    (tmp_path / "0.data").write_bytes(whole)
    assert folder_rows(spark, tmp_path) == {b"ash": b"1", b"elm": b"2"}
    # a merge that stopped after its journal was written is finished by whoever opens the folder
    os.makedirs(tmp_path / ".merge", exist_ok=True)
    (tmp_path / ".merge" / "0.data").write_bytes(rawlog.encode_data(1, b"ash", b"9"))
    (tmp_path / ".journal").write_text(json.dumps({"old": ["0.data"], "new": [[".merge/0.data", "0.data"]]}))
    assert folder_rows(spark, tmp_path) == {b"ash": b"9", b"elm": b"2"} and not (tmp_path / ".journal").exists()


def test_keys_are_utf8(spark, tmp_path):
    (tmp_path / "0.data").write_bytes(rawlog.encode_data(1, b"ok", b"1") + rawlog.encode_data(1, b"\xff\xfe", b"1") + rawlog.encode_data(1, b"more", b"1"))
    got = rows(spark, tmp_path, mode="report").orderBy("pos").collect()
    assert [r.reason for r in got] == [None, "InvalidUtf8"] and rows(spark, tmp_path).count() == 1
    assert abs(rawlog.new_timestamp() / 1e9 - __import__("time").time()) < 5


def test_wals_become_runs(spark, tmp_path):
    from cairnlog.sources import folder, sstable

    wal, out = tmp_path / "wal", tmp_path / "runs"
    wal.mkdir()
    (wal / "3.wal").write_bytes(b"".join([rawlog.encode_wal(1, b"b", b"1"), rawlog.encode_wal(2, b"a", b"2"), rawlog.encode_wal(3, b"b", None)]))
    (wal / "12.wal").write_bytes(rawlog.encode_wal(4, b"a", b"3") + rawlog.encode_wal(5, b"c", b"4")[:-1])
    assert folder.flush_wals(spark, str(wal), str(out)) == 2 and not list(wal.glob("*.wal"))
    first, second = (sstable.Run(str(out / n)) for n in ("0.sst", "1.sst"))
    assert list(first.entries()) == [(b"a", b"2", False, 2), (b"b", b"", True, 3)] and list(second.entries()) == [(b"a", b"3", False, 4)]
    assert sstable.newest([first, second], b"a")[1] == b"3" and sstable.newest([first, second], b"b") is None
    assert folder.flush_wals(spark, str(wal), str(out)) == 0


def test_runs_are_written_by_spark(spark, tmp_path):
    from cairnlog.sources import sstable

    spark.dataSource.register(sstable.RunSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    made = spark.range(3000).selectExpr("cast(lpad(id, 6, '0') AS binary) AS key", "cast('v' AS binary) AS value", "id % 7 = 0 AS deleted", "id AS tstamp")
    for _ in range(2):
        made.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("runs").mode("append").option("path", str(tmp_path)).save()
    assert sorted(os.listdir(tmp_path)) == [f"{i}.sst" for i in range(6)]
    back = spark.read.format("runs").option("path", str(tmp_path)).load()
    assert back.count() == 6000 and back.select("key").distinct().count() == 3000 and back.where("deleted").count() == 2 * made.where("deleted").count()
    with pytest.raises(Exception, match="exist"):
        made.withColumn("run", __import__("pyspark").sql.functions.lit(0)).coalesce(1).sortWithinPartitions("key").write.format("runs").mode("append").option("path", str(tmp_path)).save()
    with pytest.raises(Exception, match="order"):
        made.coalesce(1).orderBy("tstamp", ascending=False).write.format("runs").mode("append").option("path", str(tmp_path)).save()
    assert back.count() == 6000


def test_decode_is_bounded():
    import io

    huge = rawlog.struct.pack("<IQQQ", 0, 1, 2**63, 2**63)
    assert [r[-1] for r in rawlog.decode(io.BytesIO(huge), len(huge), "data")] == ["MetaDataSizeExceedsFileSize"]
    assert rawlog.in_order(["10.data", "x.data", "9.data"]) == ["x.data", "9.data", "10.data"]
    assert DataCorrupted("f", 3, "Other").offset == 3


def test_stream(spark, tmp_path):
    for i in range(4):
        batch = [(f"k{j % 5}", 10 * i + j, i, j == 3, f"v{i}{j}") for j in range(8)]
        spark.createDataFrame(batch, KV_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = compacted(read_log(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.key: (r.seq, r.value) for r in read_compacted(spark, str(tmp_path / "out")).collect()}
    assert got == {r.key: (r.seq, r.value) for r in latest(spark.read.schema(KV_LOG).parquet(str(tmp_path / "in"))).collect()}


def test_runs(spark, tmp_path):
    from cairnlog.operators.resolve import newest as resolved
    from cairnlog.sources import sstable

    keys = [f"k{i:05}".encode() for i in range(0, 4000, 2)]
    sstable.write_run(str(tmp_path / "9.sst"), [(k, b"old" + k, False, 1) for k in keys])
    sstable.write_run(str(tmp_path / "10.sst"), [(k, b"", True, 2) for k in keys[:500]] + [(keys[500], b"new", False, 2)])
    runs = [sstable.Run(str(tmp_path / n)) for n in ("9.sst", "10.sst")]
    assert len(runs[0].blocks) > 5 and runs[0].least == keys[0] and runs[0].greatest == keys[-1]
    assert all(runs[0].may_have(k) for k in keys)
    assert sum(runs[0].may_have(f"k{i:05}".encode()) for i in range(1, 4000, 2)) < 60
    assert sstable.newest(runs, keys[3]) is None and sstable.newest(runs, keys[500])[1] == b"new" and sstable.newest(runs, keys[501])[1] == b"old" + keys[501]
    assert runs[0].find(b"k00001") is None and runs[1].find(keys[0])[2]
    spark.dataSource.register(sstable.RunSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    df = spark.read.format("runs").option("path", str(tmp_path)).load()
    assert df.count() == 2501
    live = resolved(df, ["key"], ["seg"]).where("NOT deleted")
    assert live.count() == 1500
    assert [bytes(r.value) for r in live.where(f"key = X'{keys[501].hex()}'").collect()] == [b"old" + keys[501]]
    sstable.write_run(str(tmp_path / "none.sst"), [])
    assert list(sstable.Run(str(tmp_path / "none.sst")).entries()) == []
    with pytest.raises(ValueError):
        sstable.write_run(str(tmp_path / "x.sst"), [(b"b", b"", False, 0), (b"a", b"", False, 0)])
    whole = (tmp_path / "9.sst").read_bytes()
    (tmp_path / "bad.sst").write_bytes(b"\xff" + whole[1:])
    with pytest.raises(DataCorrupted, match="CrcMismatch"):
        sstable.Run(str(tmp_path / "bad.sst")).find(keys[0])
    (tmp_path / "cut.sst").write_bytes(whole[:3000] + whole[-64:])
    with pytest.raises(DataCorrupted, match="MetaDataSizeExceedsFileSize"):
        sstable.Run(str(tmp_path / "cut.sst"))
    (tmp_path / "tiny.sst").write_bytes(b"abc")
    with pytest.raises(DataCorrupted, match="LengthMismatch"):
        sstable.Run(str(tmp_path / "tiny.sst"))


def test_small_files_share_tasks(spark, tmp_path):
    """q37 to q39: tasks grow with the bytes of a folder, not with its files."""
    for i in range(400):
        (tmp_path / f"{i}.data").write_bytes(rawlog.encode_data(i, b"k%d" % (i % 7), b"v%d" % i) + rawlog.encode_data(i, b"old%d" % i, b"" if i % 2 else b"w"))
    found = rows(spark, tmp_path)
    assert found.rdd.getNumPartitions() == 1 and rows(spark, tmp_path, "keys").rdd.getNumPartitions() == 1
    got = sorted(found.collect(), key=lambda r: r.seq)
    assert [(os.path.basename(r.file), r.seg, r.tstamp) for r in got] == [(f"{i}.data", i, i) for i in range(400) for _ in range(2)]
    assert rows(spark, tmp_path, mode="report").where("reason IS NULL").count() == 800
    (tmp_path / "200.data").write_bytes(rawlog.encode_data(1, b"k", b"v") + b"short")  # ends its own file only
    assert rows(spark, tmp_path).count() == 799


def test_neighbours():
    import random

    rnd = random.Random(3)
    for most in (1, 10**5, 10**6):
        sizes = [rnd.choice([0, 10, 10**4, 10**6]) for _ in range(100)]
        groups = rawlog.neighbours(sizes, most)
        assert [i for g in groups for i in g] == list(range(100))
        assert all(len(g) == 1 or sum(sizes[i] + rawlog.OPEN_COST for i in g) <= most for g in groups)
    assert rawlog.neighbours([]) == [] and rawlog.neighbours([5]) == [range(1)]


def test_merge_of_many_files(spark, tmp_path, monkeypatch):
    """Files of `limit` bytes and no more of them than there were, whatever the old ones' sizes, with few tasks or many."""
    import random

    from cairnlog.sources import folder

    rnd = random.Random(5)
    for case, (limit, split) in enumerate([(4096, 8 << 20), (1, 8 << 20), (4096, 1), (1, 40_000), (1 << 20, 40_000)]):
        monkeypatch.setattr(folder, "neighbours", lambda sizes, split=split: rawlog.neighbours(sizes, split))
        path, want, number = tmp_path / str(case), {}, 0
        path.mkdir()
        for number in range(60):
            out = b""
            for _ in range(rnd.choice([0, 1, 40])):
                key, value = b"k%d" % rnd.randrange(300), bytes(rnd.randrange(1, 256) for _ in range(rnd.choice([0, 5, 50, 3000 if number == 17 else 9])))
                want[key] = value
                out += rawlog.encode_data(number, key, value)
            (path / f"{number + 2}.data").write_bytes(out)
        active = (path / f"{number + 2}.data").read_bytes()
        folder.merge(spark, str(path), limit)
        assert folder_rows(spark, path) == {k: v for k, v in want.items() if v}
        kept = {n: (path / n).stat().st_size for n in os.listdir(path) if n.endswith(".data") and n != f"{number + 2}.data"}
        assert (path / f"{number + 2}.data").read_bytes() == active and len(kept) <= 59 and {f"{n[:-5]}.hint" for n in kept} == {n for n in os.listdir(path) if n.endswith(".hint")}
        if split > 1 << 20 and limit == 4096:
            assert all(n >= limit for n in [kept[n] for n in rawlog.in_order(list(kept))][:-1])


def test_merge_of_what_is_all_dead(spark, tmp_path):
    from cairnlog.sources import folder

    spark.dataSource.register(rawlog.RawLogSource)
    write_data(spark, tmp_path, [("ash", "1"), ("elm", None)], 1)
    write_data(spark, tmp_path, [("oak", "1")], 1)
    write_data(spark, tmp_path, [("ash", None), ("oak", None)], 2)
    folder.merge(spark, str(tmp_path))
    assert folder_rows(spark, tmp_path) == {} and [n for n in os.listdir(tmp_path) if n.endswith((".data", ".hint"))] == ["2.data"]


def test_merge_reads_values_with_checksums(spark, tmp_path):
    """Values are read after keys were resolved; what has gone bad by then is not given a new checksum."""
    from cairnlog.sources import folder

    spark.dataSource.register(rawlog.RawLogSource)
    write_data(spark, tmp_path, [("ash", "1"), ("elm", "22")], 1)
    found = folder._read(spark, str(tmp_path), "data", "failfast", values=False)
    assert found.where("value IS NOT NULL").count() == 0
    assert [bytes(r.value) for r in folder._values(found.drop("value"), checked=True).collect()] == [b"1", b"22"]
    listed = spark.createDataFrame(found.drop("value").collect(), found.drop("value").schema)
    whole = (tmp_path / "0.data").read_bytes()
    (tmp_path / "0.data").write_bytes(whole[:-1] + b"X")
    with pytest.raises(Exception, match="CrcMismatch"):
        folder._values(listed, checked=True).collect()


def test_events_are_written_by_all_cores(spark, tmp_path):
    """The files of q37 to q39 were written by four tasks, however large the table and many the cores."""
    from cairnlog.plans import catalogue

    made = spark.range(600_000).selectExpr("id AS event_id", "id % 1000 AS user_id", "if(id % 5 = 0, 'error', 'view') AS event_type", "sha2(cast(id AS string), 256) AS props")
    made.write.parquet(str(tmp_path / "events.parquet"))
    tracker, group = spark.sparkContext.statusTracker(), "events-written"
    spark.sparkContext.setJobGroup(group, group)
    path = catalogue._as_files(spark, str(tmp_path))
    job = tracker.getJobInfo(max(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tracker.getStageInfo(max(job.stageIds)).numTasks > 4
    back = rows(spark, path, mode="failfast").select("seq", "tstamp").orderBy("seq").collect()
    assert [r.tstamp for r in back] == list(range(600_000))


def test_many_wals_become_runs(spark, tmp_path):
    """q39: a task reads and writes many WALs, and each gives the run it would give alone."""
    from cairnlog.sources import folder, sstable

    wal, out = tmp_path / "wal", tmp_path / "runs"
    wal.mkdir()
    out.mkdir()
    sstable.write_run(str(out / "4.sst"), [(b"k1", b"before", False, 0)])
    want = {}
    for i in range(300):
        ops = [(b"k%d" % (j * i % 5), None if (i + j) % 4 == 0 else b"v%d.%d" % (i, j)) for j in range(i % 9)]
        (wal / f"{i}.wal").write_bytes(b"".join(rawlog.encode_wal(10 * i + j, k, v) for j, (k, v) in enumerate(ops)) + (b"\x09" if i % 50 == 7 else b""))
        last = {k: (k, v or b"", v is None, 10 * i + j) for j, (k, v) in enumerate(ops)}
        if last:
            want[i + 5] = [last[k] for k in sorted(last)]
    assert rows(spark, wal, "wal").rdd.getNumPartitions() == 1
    tracker, group = spark.sparkContext.statusTracker(), "flushed"
    spark.sparkContext.setJobGroup(group, group)
    assert folder.flush_wals(spark, str(wal), str(out)) == 300
    tasks = [s.numTasks for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i))]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(tasks) == 1
    assert {int(n[:-4]): list(sstable.Run(str(out / n)).entries()) for n in os.listdir(out)} == {4: [(b"k1", b"before", False, 0)], **want}
    spark.dataSource.register(sstable.RunSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    back = spark.read.format("runs").option("path", str(out)).load()
    assert back.rdd.getNumPartitions() == 1 and back.count() == 1 + sum(map(len, want.values()))
    assert sorted(int(os.path.basename(r.file)[:-4]) for r in back.where(f"key = X'{b'k1'.hex()}'").collect()) == sorted(i for i, r in {**want, 4: [(b"k1",)]}.items() if any(e[0] == b"k1" for e in r))


def test_filter_bits_are_those_of_single_keys():
    import struct

    from cairnlog.sources import sstable

    for keys in ([], [b""], [b"a", b"b" * 99], [b"k%d" % i for i in range(3000)]):
        words = [0] * max(1, -(-len(keys) * sstable.BLOOM_BITS_PER_KEY // 64))
        for k in keys:
            for p in sstable.bloom_positions(k, 64 * len(words) - 1):
                words[p >> 6] |= 1 << (p & 63)
        assert sstable.filter_words(keys) == struct.pack(f"<{len(words)}Q", *words)
