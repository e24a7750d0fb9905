"""The key-value log against a dictionary, and the published constants of the event log."""

import random
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairnlog.functions import binary, bloom
from cairnlog.functions.scan import running_total
from cairnlog.model import KV_LOG, DataCorrupted, MissingKey, SizeLimit
from cairnlog.operators import access, compact, resolve, runs, verify
from cairnlog.operators.store import Store
from cairnlog.plans.catalogue import kv_log
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def log_of(spark, ops, per_seg=4):
    rows = [(k, i, i // per_seg, v is None, v or "") for i, (k, v) in enumerate(ops)]
    return spark.createDataFrame(rows, KV_LOG)


def pairs(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_get_after_put(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put("birch", "white")
    store.sync()
    assert store.get("birch") == "white"


def test_delete_after_put(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put("birch", "white")
    assert store.get("birch") == "white"  # before any commit
    store.delete("birch")
    assert store.get("birch") is None
    with pytest.raises(MissingKey):
        store.get("birch", strict=True)
    with pytest.raises(MissingKey):
        store.delete("birch", strict=True)


def test_list_fold_merge_reopen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in ("ash", "oak", "yew", "elm"):
        store.put(k, "tree")
    store.sync()
    assert sorted(store.list_keys()) == ["ash", "elm", "oak", "yew"]
    assert store.fold(lambda k, v, acc: acc + [k], []) == ["ash", "elm", "oak", "yew"]
    store.delete("yew")
    store.delete("elm")
    store.sync()
    store.put("late", "")
    store.merge()
    assert sorted(store.list_keys()) == ["ash", "late", "oak"]
    assert store.get("late") == "" and store.get("yew") is None
    # writes after a merge win over what it kept, also when opened again
    store.put("ash", "again")
    store.delete("oak")
    store.close()
    again = Store(spark, str(tmp_path))
    assert {k: again.get(k) for k in ("ash", "oak", "late")} == {"ash": "again", "oak": None, "late": ""}
    again.put_all(spark.createDataFrame([("bulk", "1"), ("ash", "2")], "key string, value string"))
    again.merge()
    assert pairs(resolve.live(again.log())) == {"bulk": "1", "ash": "2", "late": ""}


def test_two_stores_on_one_folder(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path), sync_every=0)
    a.put("k", "of a")
    b.put("k", "of b")  # committed at once
    a.sync()
    assert a.get("k") == b.get("k") == "of a"  # the later commit wins
    assert {r.seg for r in a.log().collect()} == {0, 1}
    b.put("k", "of b again")
    assert a.get("k") == "of b again"


def test_limits(spark):
    access.check_pair("k" * 16384, "v" * 131072)
    for k, v in (("k" * 16385, ""), ("k", "v" * 131073)):
        with pytest.raises(SizeLimit):
            access.check_pair(k, v)
    bad = spark.createDataFrame([("k" * 16385, 1, 0, "")], "key string, seq long, seg long, value string")
    with pytest.raises(Exception, match="above the limit"):
        access.put(log_of(spark, []), bad).collect()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "é", "a\x00", "\x7f", "\x80"]), st.none() | st.sampled_from(["", "x", "yy"])), max_size=25))
def test_against_dictionary(spark, ops):
    log = log_of(spark, ops)
    want, rejected, tomb = {}, 0, {}
    for k, v in ops:
        if v is None:
            rejected += k not in want
            want.pop(k, None)
        else:
            want[k] = v
        tomb[k] = v
    assert pairs(resolve.live(log)) == want
    assert pairs(resolve.live(log, "log")) == {k: v for k, v in want.items() if v}
    assert access.rejected_deletes(log).count() == access.rejected_deletes(log, 3).count() == rejected
    assert pairs(runs.tiered(runs.flushed(log))) == want
    assert {r["key"]: None if r["deleted"] else r["value"] for r in resolve.latest(log).collect()} == tomb
    assert compact.recovery_differences(log).first() == (0, 0)
    kept = compact.merged(log).collect()
    last = (len(ops) - 1) // 4
    assert sorted(r["key"] for r in kept) == sorted(k for k, v in want.items() if max(i for i, o in enumerate(ops) if o[0] == k) // 4 < last)


def test_strict_delete(spark):
    log = log_of(spark, [("a", "1"), ("b", "2"), ("b", None)])
    keys = spark.createDataFrame([("a", 10, 9), ("b", 11, 9), ("c", 12, 9)], "key string, seq long, seg long")
    after, refused = access.delete_strict(log, keys)
    assert pairs(resolve.live(after)) == {} and sorted(r.key for r in refused.collect()) == ["b", "c"]
    got = {r.key: (r.found, r.value) for r in access.multi_get(log, keys).collect()}
    assert got == {"a": (True, "1"), "b": (False, None), "c": (False, None)}


def test_fold_chunks(spark):
    log = log_of(spark, [(f"k{i:03}", str(i)) for i in range(50)])
    got = access.fold_chunks(log, F.concat("key", F.lit("="), "value"), ",", 4).orderBy("chunk").collect()
    assert ",".join(r.text for r in got) == ",".join(f"k{i:03}={i}" for i in range(50))
    assert access.fold_ordered(log, 0, lambda a, k, v: a * 3 % 1009 + v.cast("int")).first()[0] is not None


def test_event_log_constants(spark):
    log = kv_log(spark, SF).cache()
    assert resolve.latest(log).count() == 150 and resolve.live(log).count() == 120
    assert log.where("NOT deleted").transform(resolve.latest).count() == 150  # what filtering too early would give
    assert access.rejected_deletes(log).count() == 434
    assert runs.flushed(log).count() == 7348
    assert compact.directory(compact.positioned(log)).agg(F.sum("value_pos")).first()[0] == 253224
    merged = compact.merged(log).agg(F.count(F.lit(1)), F.sum(compact.record_bytes())).first()
    assert tuple(merged) == (60, 2351)
    assert runs.sparse_index(runs.block_cuts(runs.flushed(log), 1024)).count() == 300
    assert runs.files(log, 1024).select("seg", "file").distinct().count() == 400
    space = compact.dead_space(log).agg(F.sum("bytes"), F.sum("live_bytes")).first()
    assert tuple(space) == (373681, 4703)
    log.unpersist()


def test_value_filters_stay_above_resolution(spark):
    plan = resolve.live(kv_log(spark, SF)).where("value <> 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Window")
    scan = access.get(spark.read.parquet(f"{SF}/events.parquet").selectExpr("props AS key", "event_id AS seq", "0L AS seg", "false AS deleted", "props AS value"), "z")
    assert "EqualTo(props,z)" in scan._jdf.queryExecution().executedPlan().toString()


def test_record_bytes(spark):
    cases = [(7, "key", "value"), (2**62 + 5, "é", ""), (0, "", "v" * 300)]
    df = spark.createDataFrame(cases, "t long, k string, v string")
    t, k, v = F.col("t"), F.col("k"), F.col("v")
    got = df.select(
        binary.data_record(t, k, v), binary.hint_record(k, t, binary.size_of(v), F.lit(9)), binary.wal_record(F.lit(False), t, k, v),
        binary.wal_record(F.lit(True), t, k, v), binary.run_record(t, F.lit(True), k, v),
    ).collect()
    for (t, k, v), row in zip(cases, got):
        k, v = k.encode(), v.encode()
        crc = lambda b: struct.pack("<I", zlib.crc32(b))
        body = struct.pack("<QQQ", t, len(k), len(v)) + k + v
        assert bytes(row[0]) == crc(body) + body
        assert bytes(row[1]) == struct.pack("<Q", len(k)) + k + struct.pack("<QQQ", t, len(v), 9)
        put, gone = b"\x04" + body, b"\x02" + struct.pack("<QQ", t, len(k)) + k
        assert bytes(row[2]) == put + crc(put) and bytes(row[3]) == gone + crc(gone)
        assert bytes(row[4]) == struct.pack("<QQQB", t, len(k), len(v), 1) + k + v
    assert spark.sql("SELECT X'FFFFFFFFFFFFFFFF' b").select(binary.from_little(F.col("b"), 1)).first()[0] == 2**64 - 1
    assert spark.sql("SELECT crc32('123456789') c").first()[0] == 0xCBF43926


def test_damage(spark):
    log = log_of(spark, [(f"k{i}", "v") for i in range(12)])
    ok = ~F.col("seq").isin(2, 9)
    assert [r.seq for r in verify.truncated(log, ok).orderBy("seq").collect()] == [0, 1, 4, 5, 6, 7, 8]
    with pytest.raises(Exception, match="is corrupt"):
        verify.failfast(log, ok).collect()
    found = verify.report(log.withColumn("pos", F.col("seq")), F.when(~ok, "CrcMismatch"), F.lit(1), F.lit(2))
    assert found.count() == 2
    with pytest.raises(DataCorrupted, match="CrcMismatch"):
        verify.raise_first(found)
    reasons = spark.createDataFrame(
        [(3, 1, 1, 9, True), (4, 16385, 1, 1 << 20, True), (4, 1, 131073, 1 << 20, True), (4, 16384, 131072, 1 << 20, True), (2, 5, 0, 4, True), (2, 5, 0, 5, False)],
        "tag int, k long, v long, rest long, ok boolean",
    ).select(verify.wal_reason(F.col("tag"), F.col("k"), F.col("v"), F.col("rest"), F.col("ok")))
    assert [r[0] for r in reasons.collect()] == ["UnknownTag", "KeyTooLong", "ValueTooLong", None, "LengthMismatch", "CrcMismatch"]


def test_bloom(spark):
    keys = spark.range(5000).selectExpr("0L AS seg", "concat('key', id) AS key")
    words = bloom.packed(bloom.build(keys)).cache()
    assert bloom.probe(words, keys).where("NOT maybe").count() == 0
    others = spark.range(5000, 15000).selectExpr("0L AS seg", "concat('key', id) AS key")
    assert bloom.probe(words, others).where("maybe").count() < 0.02 * 10000
    few = spark.createDataFrame([(1, "only"), (2, "\x80")], "seg long, key string")
    assert bloom.probe(bloom.packed(bloom.build(few)), few).where("maybe").count() == 2


def test_greedy_cuts(spark):
    rnd = random.Random(2)
    log = log_of(spark, [(f"k{i:04}", "v" * rnd.randrange(0, 90)) for i in range(300)], per_seg=100)
    want_files, want_blocks = {}, {}
    for seg in range(3):
        file = at = block = filled = 0
        for r in sorted(log.where(F.col("seg") == seg).collect(), key=lambda r: r.seq):
            n = 28 + len(r.key) + len(r.value)
            if at and at + n > 200:
                file, at = file + 1, 0
            want_files[r.seq] = (file, at)
            at += n
            want_blocks[r.seq] = block
            filled += n - 3
            if filled > 200:
                block, filled = block + 1, 0
    assert {r.seq: (r.file, r.offset) for r in runs.files(log, 200).collect()} == want_files
    assert {r.seq: r.block for r in runs.blocks(log, 200).collect()} == want_blocks
    assert runs.files(log.limit(0), 200).count() == 0


def test_running_total(spark):
    rows = spark.range(1000).selectExpr("id * 37 AS seq", "id % 7 AS n")
    for span, levels in ((256, 1), (256, 2), (16, 3)):
        found = running_total(rows, "seq", F.col("n"), "b", span, levels)
        assert found.columns == ["seq", "n", "b"]
        got = {r.seq: r.b for r in found.collect()}
        total = 0
        for i in range(1000):
            assert got[i * 37] == total
            total += i % 7


def test_running_total_keeps_rows_without_an_order(spark):
    rows = spark.createDataFrame([(None, 5), (None, 6), (3, 1), (None, 7)], "seq long, n int")
    got = running_total(rows, "seq", F.col("n"), "b").collect()
    assert len(got) == 4 and [r.b for r in got if r.seq == 3] == [18]


def test_candidates_of_many_runs(spark):
    rnd = random.Random(4)
    made = [(i, *sorted((f"{rnd.randrange(10**6):06}", f"{rnd.randrange(10**6):06}"))) for i in range(200)]
    probes = [f"{rnd.randrange(10**6):06}" for _ in range(150)] + ["", "zzz"]
    found = runs.candidates(spark.createDataFrame(made, "seg long, min_key string, max_key string"), spark.createDataFrame([(p,) for p in probes * 2], "key string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(p, i) for p in probes for i, lo, hi in made if lo <= p <= hi}
    assert runs.candidates(spark.createDataFrame(made, "seg long, min_key string, max_key string"), spark.createDataFrame([], "key string")).count() == 0


def test_wal_records_decoded(spark):
    from cairnlog.sources.rawlog import encode_wal

    whole = [encode_wal(7, b"key", b"value"), encode_wal(8, b"k", None), encode_wal(9, b"", b"")]
    cases = [*whole, whole[0][:-1] + b"x", whole[0][:20], b"", None, b"\x04" + b"\xff" * 40]
    df = spark.createDataFrame([(None if c is None else bytearray(c),) for c in cases], "r binary").coalesce(1)
    got = binary.wal_decoded(df, "r").collect()
    assert [(r.tag, r.tstamp, bytes(r.key), r.value and bytes(r.value), r.crc_ok) for r in got[:3]] == [(4, 7, b"key", b"value", True), (2, 8, b"k", None, True), (4, 9, b"", b"", True)]
    assert not any(r.crc_ok for r in got[3:]) and got[7].key_size == got[7].value_size == 2**63 - 1
    assert [r.n for r in got[3:7]] == [len(whole[0]), 20, 0, 0] and got[4].value_size == 5 % 2**24


def test_merge_of_a_damaged_log_fails(spark):
    log = log_of(spark, [("a", "1"), ("b", "2"), ("c", "3")], per_seg=2)
    assert compact.merged(log, F.lit(True)).count() == 2
    with pytest.raises(Exception, match="is corrupt"):
        compact.merged(log, F.col("seq") != 1).collect()


def test_key_order_is_by_bytes(spark):
    log = log_of(spark, [("\x80", "1"), ("a", "1"), ("a\x00", "1"), ("\x7f", "1"), ("10", "1"), ("9", "1")], 10)
    row = runs.manifest(log).first()
    assert (row.min_key, row.max_key) == ("10", "\x80")
    names = spark.createDataFrame([("10",), ("9",), ("abc",)], "name string")
    assert [r.name for r in compact.segment_order(names).orderBy("place").collect()] == ["abc", "9", "10"]
