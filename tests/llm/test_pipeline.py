"""The pipeline: each stage on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from cairnlog.llm import quality, secret_scan, simhash
from cairnlog.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources", "best-fit packing"]
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    good, distinct, clean, mixed, packed = kept[1:]
    model = quality.fitted(docs, table(spark, SF, "labels"))
    own = docs.collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, s in zip(own, model.score([r.text for r in own])) if s >= 0.3}
    groups = {r.component_id for r in simhash.near_duplicates(good).collect()}
    assert Counter(r.doc_id for r in distinct.collect()) == Counter(groups)
    left = secret_scan.scan(clean, secret_scan.forest(spark)).where("is_secret").count()
    assert left == 0 and clean.count() == distinct.count()
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    rows = packed.collect()
    assert sum(r.length for r in rows) == tokens
    full = Counter()
    for r in rows:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 4096


def test_stages_keep_odd_rows(spark, odd_docs, tmp_path):
    """Null and repeated ids, clashing names and marks: each stage returns its columns and loses no text that it should keep."""
    docs = odd_docs.withColumnsRenamed({"score": "_score", "seg": "_row", "root": "_n", "h": "_mix_row"})
    texts = {r.text for r in docs.collect()}
    labels = [(0, 1), (5, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        if name == "quality classifier":
            continue  # what it keeps is for the model to say
        found = Counter(r.text for r in out.collect())
        if name == "SimHash near-dedup":
            assert found.keys() < texts and sum(found.values()) == len(found)
        else:
            assert found.keys() == texts, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_clean(spark, docs):
    from cairnlog.llm import common

    kept = common.written(docs.select("doc_id"), "some")
    assert kept.count() == docs.count()
    common.clean(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(common.scratch(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
