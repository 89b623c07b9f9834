"""The corpus pipeline stage by stage: planted cases, and no other row lost."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from seamark.llm import pieces
from seamark.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.select(max((f.name for f in bench.schema if f.dataType.simpleString() == "string"), key=lambda c: bench.agg(F.max(F.length(c))).first()[0])).orderBy(F.length(F.col(bench.columns[-1])).desc()).first()[0]
    draw = random.Random(3)
    words = sorted({w for r in docs.where("lang = 'en'").limit(50).collect() for w in (r["text"] or "").split() if w.isalpha()})
    clean = [" ".join(draw.choices(words, k=150)) for _ in range(4)]
    top = docs.agg(F.max("doc_id")).first()[0]
    texts = [clean[0], clean[0] + " end", clean[1] + " " + item, clean[2] + " write to jane.doe@example.org now", clean[3]]
    planted = spark.createDataFrame([(top + 1 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    planted = planted.withColumns({"lang": F.lit("en"), "source": F.lit("planted"), "n_chars": F.length("text").cast("long")})
    rows = stored(docs.unionByName(planted.select(*(F.col(c).cast(docs.schema[c].dataType) if c in planted.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stored(stage(spark, rows, sf_dir))
        assert rows.count() == rows.join(before.select("doc_id").distinct(), "doc_id", "left_semi").count(), name
        left[name] = {r["doc_id"] - top for r in rows.where(F.col("doc_id") > top).select("doc_id").collect()}
        if name == "pii":
            assert rows.count() == before.count()
            text = {r["doc_id"] - top: r["text"] for r in rows.where(F.col("doc_id") > top).collect()}
            assert text[1] == clean[0] and text[5] == clean[3] and "jane.doe" not in text[4]
        if name == "pieces":
            assert rows.count() == before.count()
            vocabulary = pieces.Vocabulary.load()
            assert {r["doc_id"] - top: vocabulary.decode(r["ids"]) for r in rows.where(F.col("doc_id") > top).collect()} == text
    assert left == {"language_id": {1, 2, 3, 4, 5}, "jaccard_join": {1, 3, 4, 5}, "decontamination": {1, 4, 5}, "pii": {1, 4, 5}, "pieces": {1, 4, 5}}
