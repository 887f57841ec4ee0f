import corpus_pipeline
from callproof.llm import bpe, packing, secrets
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = spark.createDataFrame(stage(spark, before, sf).toPandas(), docs.schema)
        assert after.columns == docs.columns
        if k < 3:
            assert 0 < after.count() <= before.count(), name
            assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        else:
            assert after.count() == before.count()
            hit = secrets.secrets(before).where("spans <> ''").select("doc_id")
            assert after.join(hit, "doc_id").where(~F.contains("text", F.lit(secrets.MASK))).count() == 0
        before = after
    want = packing.packed(before, bpe.vocabulary(), with_ids=False)
    got = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.select(key).exceptAll(want.select(key)).count() == 0 and got.count() == want.count()


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_packing_gives_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    rows = corpus_pipeline.pack(spark, docs, sf).collect()
    model = Tokenizer.from_file(bpe.vocabulary())
    ids = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert ids == {r["doc_id"]: [*model.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_TOKEN] for r in docs.collect()}
