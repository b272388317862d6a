import corpus_pipeline as p
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.llm import op07_quality, op09_toxicity
from tests.llm.test_shingles import both, near
from tests.llm.test_simhash import brute


def test_stages(spark, sf):
    """Each stage does what it says to all that the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = p.toxicity(spark, docs, sf)
    assert clean.schema == docs.schema
    toxic = {r["doc_id"] for r in op09_toxicity.score(docs, op09_toxicity.fit(docs, labels)).where("score >= 0.5").collect()}
    left = set(texts) - toxic
    assert {r["doc_id"] for r in clean.collect()} == left and toxic
    good = p.quality(spark, clean, sf)
    poor = {r["doc_id"] for r in op07_quality.score(clean, op07_quality.fit(clean, labels)).where("score < 0.3").collect()}
    left -= poor
    assert {r["doc_id"] for r in good.collect()} == left and poor and good.columns == docs.columns
    one = p.near_duplicates(spark, good, sf)
    left = set(brute([(k, *both(texts[k])) for k in left], near).values())
    kept = [r["doc_id"] for r in one.collect()]
    assert sorted(kept) == sorted(left) and set(one.columns) == set(docs.columns)
    assert len({texts[k] for k in kept}) == len(kept)
    pieces = p.packing(spark, one, sf)
    assert {r["doc_id"] for r in pieces.collect()} == left


def test_run_packs_what_is_left(spark, sf):
    rows = p.run(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for sequence in by.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or at & (at - 1) == 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "packing"] and p.ORACLE_SQL is None


def through(spark, docs, sf_dir):
    """All stages but the last, as ``run`` chains them."""
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    return docs


def test_odd_rows(spark, sf):
    """Null texts and ids, repeated rows, one id with two texts, an empty and a very long text, columns of any name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    base = docs.withColumns({"part": F.lit("x"), "_key": F.lit(1), "row": F.lit(2), "score": F.lit(0.5)})
    good = base.orderBy(F.length("text").desc()).first().asDict()
    odd = [{**good, **change} for change in (
        {"doc_id": 900_001, "text": None}, {"doc_id": 900_002, "text": ""}, {"doc_id": None}, {"doc_id": None}, {"doc_id": None, "text": None},
        {"doc_id": 900_003, "text": " ".join([good["text"]] * 300)}, {"doc_id": 900_004, "part": None}, {},
    )]
    every = base.unionByName(spark.createDataFrame(odd, T.StructType([T.StructField(f.name, f.dataType) for f in base.schema])))
    kept = through(spark, every, sf)
    rows = kept.collect()
    assert set(kept.columns) == set(every.columns)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 900_004 not in ids  # an exact copy of a document with a smaller id
    texts = [r["text"] for r in rows]
    assert len(texts) == len(set(texts))
    pieces = p.packing(spark, kept, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows} and all(r["n"] == r["all"] for r in pieces if r["doc_id"] is not None)


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert p.packing(spark, through(spark, docs, sf), sf).count() == 0


def test_without_labels(spark, sf, tmp_path):
    """Known insults alone count, and all texts are of one quality: clean documents stay."""
    spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = p.toxicity(spark, docs, str(tmp_path))
    lost = docs.join(clean, "doc_id", "left_anti").join(labels.where("toxic = 0"), "doc_id").count()
    assert lost <= 0.05 * docs.count()
    assert p.quality(spark, clean, str(tmp_path)).count() == clean.count()
