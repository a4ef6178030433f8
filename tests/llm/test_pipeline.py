import random

import corpus_pipeline
import pytest
from colloquy.llm import mixing, packing
from colloquy.llm.toxicity import INSULTS


@pytest.fixture(scope="module")
def corpus(spark, docs_of, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(7)
    words = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(12))
    clean = [(i, words() + "\n" + words(), "s" + str(i % 3)) for i in range(60)]
    toxic = [(i, f"{' '.join(sorted(INSULTS)[:9])} {words()}", "s0") for i in range(100, 130)]
    copies = [(200, clean[4][1], "s1"), (201, "a document of one line only " + "with many words " * 60, "s1"), (202, "a document of one line only " + "with many words " * 60, "s2")]
    docs_of(clean + toxic + copies).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _ in clean] + [(i, 1, 1) for i, _, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_one_by_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == docs.columns
            rows = out.collect()
            ids[name] = {r.doc_id for r in rows}
            docs = spark.createDataFrame(rows, docs.schema)
    assert ids["toxicity"] == {*range(60), 200, 201, 202}
    assert ids["line_dedup"] == {*range(60), 201}
    assert ids["simhash"] <= ids["line_dedup"] and {*range(60)} <= ids["simhash"]
    assert ids["mixing"] <= ids["simhash"]


def test_run_is_the_composition(spark, corpus):
    import public_tokenizers

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, corpus)
    mixed = mixing.mixed_documents(docs)
    want = packing.pack(mixed.coalesce(1), public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, corpus)
    total = lambda df: {r.doc_id: r["sum(length)"] for r in df.groupBy("doc_id").sum("length").collect()}
    assert total(got) == total(want)
