"""The registered queries of the key-value log, each with the SQL that checks it.

Most read one log made from the events table: the key is the user, an error event is a delete, other
events put their properties, and a hundred events make a segment.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlog.functions import binary, bloom
from cairnlog.functions.binary import size_of
from cairnlog.model import KEY_MAX, VALUE_MAX
from cairnlog.operators import access, compact, runs, verify
from cairnlog.operators.resolve import latest, live, newest
from cairnlog.sources import folder
from cairnlog.sources.rawlog import RawLogSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROBES = ["8", "42", "7", "nope"]
RUN_PROBES = ["0", "42", "99", "100", "nope"]
#: Small limits, so that the small tables have many blocks and files.
BLOCK_LIMIT = 1024
FILE_BYTES = 1024
RUN_OPS = 256

KV = """WITH kv_log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_id // 100 AS seg, event_type = 'error' AS deleted,
  CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, event_type FROM events)"""
LATEST = KV + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kv_log) WHERE rn = 1),
live AS (SELECT * FROM latest WHERE NOT deleted)"""
FLUSHED = KV + """, flushed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg, key ORDER BY seq DESC) AS rn FROM kv_log) WHERE rn = 1)"""
POSITIONED = LATEST + """, sized AS (SELECT *, 28 + strlen(key) + strlen(value) AS n FROM kv_log),
positioned AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM sized)"""
BLOCKS = FLUSHED.replace("WITH kv_log", "WITH RECURSIVE kv_log") + """, lined AS (SELECT seg, key, seq, deleted, value, 25 + strlen(key) + strlen(value) AS n,
  row_number() OVER (PARTITION BY seg ORDER BY key) AS i FROM flushed),
cut(seg, i, block, filled) AS (SELECT seg, i, CAST(0 AS BIGINT), CAST(n AS BIGINT) FROM lined WHERE i = 1
  UNION ALL SELECT l.seg, l.i, CASE WHEN c.filled > 1024 THEN c.block + 1 ELSE c.block END, CASE WHEN c.filled > 1024 THEN l.n ELSE c.filled + l.n END
  FROM cut c JOIN lined l ON l.seg = c.seg AND l.i = c.i + 1),
blocks AS (SELECT l.*, c.block FROM lined l JOIN cut c ON c.seg = l.seg AND c.i = l.i)"""
#: Bytes of a number, least first, as hex; and the checksum of bytes given as hex.
LE8 = "(SELECT string_agg(substr(h, 15 - 2 * CAST(j AS INT), 2), '' ORDER BY j) FROM (SELECT printf('%016X', CAST({} AS BIGINT)) AS h) a, range(8) r(j))"
HEX8 = "concat(" + ", ".join(f"substr(printf('%016X', CAST({{0}} AS BIGINT)), {15 - 2 * i}, 2)" for i in range(8)) + ")"
CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(8), lambda z: z::UBIGINT),
  lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS tab)"""
CRC = """xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length({0}) // 2 + 1), lambda i: ('0x' || substr({0}, (2 * i - 1)::INT, 2))::UBIGINT),
  lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"""


def kv_log(spark: SparkSession, sf_dir: str, empty_type: str | None = None) -> DataFrame:
    """The log of the events table. empty_type: events of this type put an empty value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_type") == "error"
    empty = deleted if empty_type is None else deleted | (F.col("event_type") == empty_type)
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.expr("event_id div 100").alias("seg"),
        deleted.alias("deleted"), F.when(empty, "").otherwise(F.col("props")).alias("value"),
    )


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(KV + " SELECT key, seq, seg, deleted, value FROM kv_log")
def q01_log_scan(spark, sf_dir):
    return kv_log(spark, sf_dir)


@query(LATEST + " SELECT key, seq, deleted, value FROM latest")
def q02_latest_version(spark, sf_dir):
    return latest(kv_log(spark, sf_dir)).select("key", "seq", "deleted", "value")


@query(LATEST + " SELECT key, value FROM live")
def q03_live_scan(spark, sf_dir):
    return live(kv_log(spark, sf_dir)).select("key", "value")


@query(LATEST + " SELECT key, seq, value FROM live WHERE key = '42'")
def q04_get_hit(spark, sf_dir):
    return access.get(kv_log(spark, sf_dir), "42").select("key", "seq", "value")


@query(LATEST + " SELECT p.key, l.key IS NOT NULL AS found, l.value FROM (VALUES ('8'), ('42'), ('7'), ('nope')) p(key) LEFT JOIN live l ON l.key = p.key")
def q05_multi_get(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return access.multi_get(log, access.keys_frame(log, PROBES))


@query(LATEST + " SELECT key FROM live")
def q06_list_keys(spark, sf_dir):
    return access.list_keys(kv_log(spark, sf_dir))


@query(LATEST + " SELECT p.key, l.key IS NOT NULL AS found FROM (VALUES ('8'), ('42'), ('7'), ('nope')) p(key) LEFT JOIN live l ON l.key = p.key")
def q07_contains_key(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return access.contains(log, access.keys_frame(log, PROBES))


@query(LATEST + " SELECT count(*) AS live_keys, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM live")
def q08_fold_sum(spark, sf_dir):
    return access.fold(kv_log(spark, sf_dir), F.count(F.lit(1)).alias("live_keys"), F.sum(size_of(F.col("value"))).alias("value_bytes"))


@query(LATEST + " SELECT md5(string_agg(key || '=' || value, ',' ORDER BY key)) AS digest FROM live")
def q09_fold_ordered(spark, sf_dir):
    joined = access.fold_ordered(kv_log(spark, sf_dir), "", lambda a, k, v: F.concat(a, F.when(a == "", "").otherwise(","), k, F.lit("="), v))
    return joined.select(F.md5(F.col("acc").cast("binary")).alias("digest"))


@query("""WITH base AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders),
delta AS (SELECT key, seq + 1000000000 AS seq, value || '!' AS value FROM base WHERE seq % 10 = 0),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM delta)
SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM both_) WHERE rn = 1""")
def q10_put_overwrite(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("seg"),
        F.lit(False).alias("deleted"), F.col("o_orderpriority").alias("value"),
    )
    delta = base.where("seq % 10 = 0").select("key", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit(1).cast("long").alias("seg"), F.concat("value", F.lit("!")).alias("value"))
    return latest(access.put(base, delta)).select("key", "seq", "value")


@query("""WITH base AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders)
SELECT key, value FROM base WHERE CAST(key AS BIGINT) % 7 <> 0""")
def q11_delete_blind(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("seg"),
        F.lit(False).alias("deleted"), F.col("o_orderpriority").alias("value"),
    )
    # keys that are there, and as many that never were
    gone = base.where("seq % 7 = 0").select("key", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit(1).cast("long").alias("seg"))
    never = gone.withColumns({"key": F.concat(F.lit("no-"), F.col("key"))})
    return live(access.delete(base, gone.unionByName(never))).select("key", "value")


@query(KV + """ SELECT key, seq FROM (SELECT key, seq, deleted, lag(deleted) OVER (PARTITION BY key ORDER BY seq) AS was FROM kv_log)
WHERE deleted AND coalesce(was, true)""")
def q12_delete_strict(spark, sf_dir):
    return access.rejected_deletes(kv_log(spark, sf_dir)).select("key", "seq")


@query(LATEST + """ SELECT 'flag' AS dialect, count(*) AS live_keys FROM live
UNION ALL SELECT 'log', count(*) FROM live WHERE event_type <> 'signup' AND value <> ''""")
def q13_empty_value_dialects(spark, sf_dir):
    log = kv_log(spark, sf_dir, "signup")
    count = lambda d: live(log, d).agg(F.lit(d).alias("dialect"), F.count(F.lit(1)).alias("live_keys"))
    return count("flag").unionByName(count("log"))


@query(KV + f""", numbered AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {RUN_OPS} AS run FROM kv_log)
SELECT run, count(*) AS ops, count(DISTINCT key) AS keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM numbered GROUP BY run""")
def q14_memtable_runs(spark, sf_dir):
    cut = runs.runs_by_count(kv_log(spark, sf_dir), RUN_OPS)
    return cut.groupBy("run").agg(
        F.count(F.lit(1)).alias("ops"), F.count_distinct("key").alias("keys"), F.sum(size_of(F.col("key")) + size_of(F.col("value"))).alias("bytes")
    )


@query(KV + """, running AS (SELECT *, coalesce(sum(strlen(key) + strlen(value)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM kv_log)
SELECT CAST(b // 4096 AS BIGINT) AS run, count(*) AS ops FROM running GROUP BY 1""")
def q14b_memtable_runs_by_bytes(spark, sf_dir):
    return runs.runs_by_bytes(kv_log(spark, sf_dir), 4096).groupBy("run").agg(F.count(F.lit(1)).alias("ops"))


@query(FLUSHED + " SELECT seg, key, seq, deleted, value FROM flushed")
def q15_run_dedup_sorted(spark, sf_dir):
    return runs.flushed(kv_log(spark, sf_dir)).select("seg", "key", "seq", "deleted", "value")


@query(LATEST + " SELECT key, seq, seg, value FROM live")
def q16_tiered_get(spark, sf_dir):
    return runs.tiered(runs.flushed(kv_log(spark, sf_dir))).select("key", "seq", "seg", "value")


@query(FLUSHED + " SELECT seg, count(*) AS n, count(*) FILTER (deleted) AS n_del, min(key) AS min_key, max(key) AS max_key FROM flushed GROUP BY seg")
def q17_run_manifest(spark, sf_dir):
    return runs.manifest(runs.flushed(kv_log(spark, sf_dir)))


_KEPT = FLUSHED + """, runs AS (SELECT seg, min(key) AS min_key, max(key) AS max_key FROM flushed GROUP BY seg)
SELECT p.key, count(r.seg) AS kept FROM (VALUES ('0'), ('42'), ('99'), ('100'), ('nope')) p(key) LEFT JOIN runs r ON p.key BETWEEN r.min_key AND r.max_key GROUP BY p.key"""


@query(_KEPT)
def q18_minmax_prune(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    probes = access.keys_frame(log, RUN_PROBES)
    kept = runs.candidates(runs.manifest(runs.flushed(log)), probes).groupBy("key").agg(F.count(F.lit(1)).alias("kept"))
    return probes.join(kept, "key", "left").select("key", F.coalesce("kept", F.lit(0)).alias("kept"))


BLOOM = FLUSHED + """, sizes AS (SELECT seg, greatest(64, 10 * count(*)) AS bits FROM flushed GROUP BY seg),
hashed AS (SELECT seg, bits, key, ('0x' || substr(md5(key), 1, 15))::BIGINT % bits AS a, ('0x' || substr(md5(key), 17, 15))::BIGINT % (bits - 1) + 1 AS b FROM flushed JOIN sizes USING (seg)),
spots AS (SELECT DISTINCT seg, bits, (a + i * b) % bits AS p FROM hashed, range(7) r(i))"""


@query(BLOOM + " SELECT seg, bits, p // 64 AS word, CAST(sum(CASE WHEN p % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << (p % 64) END) AS BIGINT) AS mask FROM spots GROUP BY seg, bits, p // 64")
def q19_bloom_build(spark, sf_dir):
    return bloom.build(runs.flushed(kv_log(spark, sf_dir)))


@query(BLOOM + """, asked AS (SELECT seg, bits, key, ('0x' || substr(md5(key), 1, 15))::BIGINT % bits AS a, ('0x' || substr(md5(key), 17, 15))::BIGINT % (bits - 1) + 1 AS b
  FROM (SELECT seg, key FROM flushed UNION SELECT seg + 1, key FROM flushed) JOIN sizes USING (seg)),
tried AS (SELECT t.seg, t.key, count(s.p) = 7 AS maybe FROM (SELECT seg, key, (a + i * b) % bits AS p FROM asked, range(7) r(i)) t LEFT JOIN spots s ON s.seg = t.seg AND s.p = t.p GROUP BY t.seg, t.key)
SELECT t.seg, count(f.key) AS present, count(*) FILTER (f.key IS NOT NULL AND NOT maybe) AS false_negatives, count(*) FILTER (f.key IS NULL AND maybe) AS false_positives
FROM tried t LEFT JOIN flushed f ON f.seg = t.seg AND f.key = t.key GROUP BY t.seg""")
def q20_bloom_probe(spark, sf_dir):
    """Every run's filter is asked for its own keys and for those of the run before."""
    entries = runs.flushed(kv_log(spark, sf_dir)).select("seg", "key")
    asked = entries.union(entries.select(F.col("seg") + 1, "key")).distinct()
    got = bloom.probe(bloom.packed(bloom.build(entries)), asked).join(entries.withColumn("has", F.lit(True)), ["seg", "key"], "left")
    return got.groupBy("seg").agg(
        F.count("has").alias("present"), F.count_if(F.col("has") & ~F.col("maybe")).alias("false_negatives"),
        F.count_if(F.col("has").isNull() & F.col("maybe")).alias("false_positives"),
    )


@query(BLOCKS + " SELECT seg, block, min(key) AS start_key, count(*) AS n, CAST(sum(n) AS BIGINT) AS bytes FROM blocks GROUP BY seg, block")
def q21_block_cut(spark, sf_dir):
    return runs.sparse_index(runs.block_cuts(runs.flushed(kv_log(spark, sf_dir)), BLOCK_LIMIT))


@query(BLOCKS + """, starts AS (SELECT seg, block, min(key) AS start_key FROM blocks GROUP BY seg, block),
asked AS (SELECT s.seg, p.key FROM (SELECT DISTINCT seg FROM kv_log) s CROSS JOIN (VALUES ('0'), ('42'), ('99'), ('100'), ('nope')) p(key))
SELECT a.seg, a.key, max(s.block) AS block, max(s.start_key) AS start_key FROM asked a LEFT JOIN starts s ON s.seg = a.seg AND s.start_key <= a.key GROUP BY a.seg, a.key""")
def q22_sparse_lookup(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    index = runs.sparse_index(runs.block_cuts(runs.flushed(log), BLOCK_LIMIT))
    probes = log.select("seg").distinct().withColumn("key", F.explode(F.array(*map(F.lit, RUN_PROBES))))
    return runs.floor_block(index, probes)


_BODY = f"{HEX8.format('seq')} || {HEX8.format('strlen(key)')} || {HEX8.format('strlen(value)')} || hex(encode(key)) || hex(encode(value))"


@query(KV + f", {CRC_TABLE}, hexed AS (SELECT seq, {_BODY} AS h FROM kv_log) SELECT seq, {CRC.format('h')} AS crc FROM hexed, tab")
def q23_record_crc(spark, sf_dir):
    return kv_log(spark, sf_dir).select("seq", F.crc32(binary.data_body(F.col("seq"), F.col("key"), F.col("value"))).alias("crc"))


_RUN_HEX = f"{HEX8.format('seq')} || {HEX8.format('strlen(key)')} || {HEX8.format('strlen(value)')} || CASE WHEN deleted THEN '01' ELSE '00' END || hex(encode(key)) || hex(encode(value))"


@query(BLOCKS + f", {CRC_TABLE}, hexed AS (SELECT seg, block, string_agg({_RUN_HEX}, '' ORDER BY key) AS h FROM blocks GROUP BY seg, block)"
       f" SELECT seg, block, {CRC.format('h')} AS crc FROM hexed, tab")
def q24_block_crc(spark, sf_dir):
    cut = runs.blocks(runs.flushed(kv_log(spark, sf_dir)), BLOCK_LIMIT)
    record = F.hex(binary.run_record(F.col("seq"), F.col("deleted"), F.col("key"), F.col("value")))
    bytes_ = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", record.alias("h")))), lambda r: r["h"]), ""))
    return cut.groupBy("seg", "block").agg(F.crc32(bytes_).alias("crc"))


@query(KV + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY seq) AS i FROM kv_log)
SELECT seg, seq, key, deleted FROM numbered WHERE seg % 2 = 1 OR i <= 50""")
def q25_replay_truncate(spark, sf_dir):
    """Record 50 (from 0) of every even segment has a wrong checksum."""
    log = kv_log(spark, sf_dir)
    crc = F.crc32(binary.data_body(F.col("seq"), F.col("key"), F.col("value")))
    place = F.row_number().over(Window.partitionBy("seg").orderBy("seq")) - 1
    damaged = log.withColumn("crc", F.when((place == 50) & (F.col("seg") % 2 == 0), crc.bitwiseXOR(F.lit(1).cast("long"))).otherwise(crc))
    return verify.truncated(damaged, F.col("crc") == crc).select("seg", "seq", "key", "deleted")


@query(KV + """ SELECT deleted, count(*) AS records, CAST(sum(CASE WHEN deleted THEN 21 + strlen(key) ELSE 29 + strlen(key) + strlen(value) END) AS BIGINT) AS bytes
FROM kv_log GROUP BY deleted""")
def q26_wal_sizes(spark, sf_dir):
    """Sizes of the encoded records themselves."""
    record = binary.wal_record(F.col("deleted"), F.col("seq"), F.col("key"), F.col("value"))
    return kv_log(spark, sf_dir).groupBy("deleted").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(record).cast("long")).alias("bytes"))


@query(LATEST + " SELECT key, seq AS tstamp, deleted, CASE WHEN deleted THEN NULL ELSE value END AS value FROM latest")
def q27_wal_replay(spark, sf_dir):
    """The log is encoded to bytes, decoded and checked, and the newest version of each key is kept."""
    records = kv_log(spark, sf_dir).select(binary.wal_record(F.col("deleted"), F.col("seq"), F.col("key"), F.col("value")).alias("r"))
    read = binary.wal_decoded(records, "r")
    rest = F.col("n") - F.when(F.col("tag") == 4, 29).otherwise(21)
    why = verify.wal_reason(F.col("tag"), F.col("key_size"), F.col("value_size"), rest, F.col("crc_ok"))
    good = read.where(why.isNull()).select(F.col("key").cast("string").alias("key"), "tstamp", (F.col("tag") == 2).alias("deleted"), F.col("value").cast("string").alias("value"))
    return newest(good, ["key"], ["tstamp"])


@query(f"""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 3 WHEN doc_id % 10 = 4 THEN 2 ELSE 4 END AS tag,
  strlen(CAST(doc_id AS VARCHAR)) * CASE WHEN doc_id % 50 = 0 THEN 16384 ELSE 1 END AS k, strlen(text) * (1 + doc_id % 40) AS v FROM documents)
SELECT doc_id, CASE WHEN tag NOT IN (2, 4) THEN 'UnknownTag' WHEN k > {KEY_MAX} THEN 'KeyTooLong' WHEN tag = 4 AND v > {VALUE_MAX} THEN 'ValueTooLong' ELSE 'ok' END AS reason FROM w""")
def q28_wal_validate(spark, sf_dir):
    """Documents as records: some with an unknown tag, some keys and values repeated beyond the limits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tag = F.when(F.col("doc_id") % 10 == 3, 3).when(F.col("doc_id") % 10 == 4, 2).otherwise(4)
    k = F.octet_length(F.col("doc_id").cast("string")) * F.when(F.col("doc_id") % 50 == 0, 16384).otherwise(1)
    v = F.octet_length("text").cast("long") * (1 + F.col("doc_id") % 40)
    why = verify.wal_reason(tag, k, v, k + v, F.lit(True))
    return docs.select("doc_id", F.coalesce(why, F.lit("ok")).alias("reason"))


_FILES = KV.replace("WITH kv_log", "WITH RECURSIVE kv_log") + f""", lined AS (SELECT seg, seq, 28 + strlen(key) + strlen(value) AS n, row_number() OVER (PARTITION BY seg ORDER BY seq) AS i FROM kv_log),
cut(seg, i, file, "offset", filled) AS (SELECT seg, i, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(n AS BIGINT) FROM lined WHERE i = 1
  UNION ALL SELECT l.seg, l.i, CASE WHEN c.filled + l.n > {FILE_BYTES} THEN c.file + 1 ELSE c.file END, CASE WHEN c.filled + l.n > {FILE_BYTES} THEN 0 ELSE c.filled END,
  CASE WHEN c.filled + l.n > {FILE_BYTES} THEN l.n ELSE c.filled + l.n END FROM cut c JOIN lined l ON l.seg = c.seg AND l.i = c.i + 1)
SELECT l.seg, l.seq, c.file, c."offset" FROM lined l JOIN cut c ON c.seg = l.seg AND c.i = l.i"""


@query(_FILES)
def q29_file_rotation(spark, sf_dir):
    return runs.files(kv_log(spark, sf_dir), FILE_BYTES).select("seg", "seq", "file", "offset")


@query(POSITIONED + """ SELECT l.key, l.seg, 28 + p.pos + strlen(l.key) AS value_pos, strlen(l.value) AS value_sz, l.seq AS tstamp
FROM live l JOIN positioned p ON p.seq = l.seq""")
def q30_keydir(spark, sf_dir):
    return compact.directory(compact.positioned(kv_log(spark, sf_dir)))


@query(LATEST + """, kept AS (SELECT *, 28 + strlen(key) + strlen(value) AS n FROM live WHERE seg < (SELECT max(seg) FROM kv_log)),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM kept)
SELECT seg, key, seq AS tstamp, strlen(value) AS value_sz, CAST(28 + pos + strlen(key) AS BIGINT) AS value_pos FROM placed""")
def q31_hint_projection(spark, sf_dir):
    return compact.hints(kv_log(spark, sf_dir))


@query(LATEST + " SELECT seg, seq, key, value, 28 + strlen(key) + strlen(value) AS bytes FROM live WHERE seg < (SELECT max(seg) FROM kv_log)")
def q32_merge_live(spark, sf_dir):
    return compact.merged(kv_log(spark, sf_dir)).select("seg", "seq", "key", "value", compact.record_bytes().alias("bytes"))


@query(LATEST + """ SELECT k.seg, count(*) AS rows, count(l.seq) AS live_rows, CAST(sum(28 + strlen(k.key) + strlen(k.value)) AS BIGINT) AS bytes,
CAST(coalesce(sum(CASE WHEN l.seq IS NOT NULL THEN 28 + strlen(k.key) + strlen(k.value) END), 0) AS BIGINT) AS live_bytes
FROM kv_log k LEFT JOIN live l ON l.seq = k.seq GROUP BY k.seg""")
def q33_dead_space(spark, sf_dir):
    return compact.dead_space(kv_log(spark, sf_dir))


@query(LATEST + """, newest AS (SELECT max(seg) AS seg FROM kv_log),
told AS (SELECT key, seq, strlen(value) AS n, false AS deleted FROM live WHERE seg < (SELECT seg FROM newest)),
seen AS (SELECT * FROM told UNION ALL SELECT key, seq, strlen(value), deleted FROM kv_log WHERE seg = (SELECT seg FROM newest)),
found AS (SELECT key, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM seen) WHERE rn = 1 AND NOT deleted),
whole AS (SELECT key, seq, strlen(value) AS n FROM live)
SELECT count(*) FILTER (f.key IS NULL) AS missing, count(*) FILTER (w.key IS NULL) AS extra FROM whole w FULL JOIN found f ON w.key = f.key AND w.seq = f.seq AND w.n = f.n""")
def q34_recovery_equivalence(spark, sf_dir):
    return compact.recovery_differences(kv_log(spark, sf_dir))


@query("""WITH names AS (SELECT DISTINCT CAST(event_id // 100 AS VARCHAR) AS name FROM events UNION ALL SELECT n_name FROM nation)
SELECT name, row_number() OVER (ORDER BY TRY_CAST(name AS BIGINT) ASC NULLS FIRST, name) AS place FROM names""")
def q35_segment_order(spark, sf_dir):
    """Numeric segment names in the order of their numbers, after the names that are none (the nations)."""
    numbers = kv_log(spark, sf_dir).select(F.col("seg").cast("string").alias("name")).distinct()
    return compact.segment_order(numbers.union(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name")))


@query(POSITIONED + """, w AS (SELECT seg, pos, n, CASE seq % 97 WHEN 1 THEN 2000000 ELSE n END AS size, CASE seq % 97 WHEN 2 THEN 20 ELSE 28 END AS head,
  CASE seq % 97 WHEN 3 THEN NULL WHEN 4 THEN n * 3 ELSE n END AS need, seq % 97 = 5 AS bad FROM positioned),
r AS (SELECT *, CASE WHEN size > 1048576 THEN 'BufferExceedsMaxLength' WHEN head < 25 THEN 'LengthMismatch' WHEN need IS NULL THEN 'MetadataSizeOverflow'
  WHEN need > size THEN 'MetaDataSizeExceedsFileSize' WHEN bad THEN 'CrcMismatch' END AS reason FROM w)
SELECT CAST(seg AS VARCHAR) AS seg, pos, reason, CAST(n AS VARCHAR) AS expected, CAST(size AS VARCHAR) AS found,
'segment ' || seg || ' at ' || pos || ': ' || reason || ' (expected ' || n || ', found ' || size || ')' AS message FROM r WHERE reason IS NOT NULL""")
def q36_corruption_report(spark, sf_dir):
    """Headers of some records are damaged, each in one way; the report names them."""
    log = compact.positioned(kv_log(spark, sf_dir)).withColumn("n", compact.record_bytes())
    hit = F.col("seq") % 97
    size = F.when(hit == 1, F.lit(2_000_000)).otherwise(F.col("n")).cast("long")
    head = F.when(hit == 2, 20).otherwise(28)
    need = F.call_function("try_add", F.when(hit == 3, F.lit(2**63 - 1)).when(hit == 4, F.col("n") * 2).otherwise(F.lit(0)).cast("long"), F.col("n"))
    why = verify.block_reason(size, head, need, hit != 5)
    return verify.report(log.withColumn("seg", F.col("seg").cast("string")), why, F.col("n"), size)


def _raw_folder(spark: SparkSession) -> str:
    """A new folder for raw files that driver and executors see: below spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base and base.removeprefix("file:").startswith("/"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    elif spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="cairnlog-raw-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    else:
        raise RuntimeError("raw files need a mounted folder: spark.checkpoint.dir")
    path = os.path.join(base, f"raw-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _as_files(spark: SparkSession, sf_dir: str, **options) -> str:
    """The event log as raw files of 64 KiB at most, in the order of seq."""
    spark.dataSource.register(RawLogSource)
    path = _raw_folder(spark)
    rows = kv_log(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "deleted", F.col("seq").alias("tstamp"))
    rows = rows.repartitionByRange("tstamp").sortWithinPartitions("tstamp")
    rows.write.format("rawlog").mode("append").options(path=path, limit=65536, **options).save()
    return path


def _text(*columns: str) -> list:
    return [F.col(c).cast("string").alias(c) if c in ("key", "value") else F.col(c) for c in columns]


@query(LATEST + " SELECT key, value, seq AS tstamp, strlen(value) AS value_sz FROM live WHERE value <> ''")
def q37_folder_open(spark, sf_dir):
    """The log is written as data files with hints; the folder is opened by the hints, and values are read where they lie."""
    found = folder.values_at(folder.opened(spark, _as_files(spark, sf_dir, hints="true")))
    return found.select(*_text("key", "value", "tstamp", "value_sz"))


@query(LATEST + " SELECT key, value, seq AS tstamp FROM live WHERE value <> ''")
def q38_folder_merge(spark, sf_dir):
    """The same folder without hints after a merge."""
    path = _as_files(spark, sf_dir)
    folder.merge(spark, path, 65536)
    return folder.values_at(folder.opened(spark, path)).select(*_text("key", "value", "tstamp"))


@query(LATEST + " SELECT key, seq AS tstamp, deleted, CASE WHEN deleted THEN '' ELSE value END AS value FROM latest")
def q39_wal_to_runs(spark, sf_dir):
    """The log is written as WALs, which are turned into sorted runs; the newest run that has a key decides."""
    runs_path = _raw_folder(spark)
    folder.flush_wals(spark, _as_files(spark, sf_dir, kind="wal"), runs_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    entries = spark.read.format("runs").option("path", runs_path).load()
    return newest(entries, ["key"], ["seg"]).select(*_text("key", "tstamp", "deleted", "value"))
