"""The pipeline on a small corpus, stage by stage against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from girder.llm import op2_quality_cnn as op2
from tests.llm.test_llm import brute_classes, edited, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(31)
    items = [" ".join(words(25, r)) for _ in range(4)]
    texts = []
    for i in range(260):
        w = words(r.randint(30, 90), r)
        if i % 4 == 0:
            w = [x + "###" for x in w]
        if i % 50 == 1:
            w[10:10] = items[i // 50 % 4].split()
        texts.append(" ".join(w))
        if i % 10 == 2:
            texts.append(" ".join(edited(w, 1, r)))
            texts.append(texts[-2])
    texts += [None, ""]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    net = op2.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {x["doc_id"] for x in op2.scored(docs, net).collect() if x["score"] >= 0.5}
    assert {i for i, t in enumerate(texts) if "###" in (t or "")}.isdisjoint(good)
    kept = stages["quality"](spark, docs, sf)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == good

    near = stages["near_duplicates"](spark, kept, sf)
    classes = defaultdict(list)
    for k, n, c in brute_classes([(i, texts[i]) for i in sorted(good)]):
        classes[c if n else ("bare", k)].append(k)
    heads = {min(v) for v in classes.values()}
    assert near.columns == docs.columns and sorted(x["doc_id"] for x in near.collect()) == sorted(heads)

    clean = stages["decontamination"](spark, near, sf)
    free = {i for i in heads if not any(z in (texts[i] or "") for z in items)}
    assert {x["doc_id"] for x in clean.collect()} == free and len(free) < len(heads)

    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == docs.columns and {x["doc_id"] for x in mixed.collect()} <= free
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    placed = stages["sharding"](spark, mixed, sf).collect()
    assert len(placed) == mixed.count() and {x["law"] for x in placed} == {"bytes"}


def test_stages_on_odd_documents(spark, tmp_path):
    r = random.Random(7)
    schema = SCHEMA + ", score double, `__id` string, copies int"
    own = lambda i, t, s="a": (i, t, "en", s, None if t is None else len(t), 0.5, "k", 1)
    long = " ".join(words(6000, r))
    rows = [own(i, " ".join(words(r.randint(5, 60), r)), ("a", "b", None)[i % 3]) for i in range(60)]
    rows += [own(None, None), own(None, ""), own(None, None), own(3, None, None), own(7, long), own(None, long), own(8, long), own(9, "one"), own(9, "one"), own(9, "two words", "b")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.where("false")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "sharding":
                assert out.columns == docs.columns, name
                out.write.mode("overwrite").parquet(str(tmp_path / f"after-{name}"))
                now = spark.read.schema(docs.schema).parquet(str(tmp_path / f"after-{name}"))
            if name == "near_duplicates" and start is docs:
                kept = [(x["doc_id"], x["text"]) for x in now.collect()]
                assert sum(t == long for _, t in kept) == 1 and (7, long) in kept and sum(t == "one" for _, t in kept) == 1 and sum(not t for _, t in kept) == 4
        placed = out.collect()
        assert len(placed) == now.count() and (placed or start is not docs)
