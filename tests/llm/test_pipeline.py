import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import byte_bpe, decontaminate, jaccard, secrets, toxicity
from riskweave.operators.runtime import stored
from tests.llm.test_jaccard import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "decontamination", "secrets", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns

    # Each stage against its operator or brute force, on what the stage before has kept.
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [k for k in before if labels.get(k) == 0]
    assert np.mean([k in kept["toxicity"] for k in clean]) >= 0.97
    texts = [(k, r.text) for k, r in kept["toxicity"].items()]
    groups = brute(texts, size=5, num=80, den=100)
    assert set(kept["jaccard"]) == {d for d, _, c in groups if d == c}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaky = {k for k, r in kept["jaccard"].items() for i in items if " ".join(i) in " ".join(decontaminate.words_of(r.text))}
    assert not leaky & set(kept["decontamination"])
    assert len(kept["jaccard"]) - len(kept["decontamination"]) <= len(leaky) + 3
    assert set(kept["secrets"]) == set(kept["decontamination"])
    for k, r in kept["secrets"].items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(before[k]):
            assert r.text == before[k] or "[SECRET]" in r.text
    codec = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec, special_tokens={})
    for k, r in kept["tokens"].items():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(kept["secrets"][k].text)


def test_odd_documents(spark, odd_documents):
    extra = odd_documents.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    docs = extra
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.filter("doc_id IS NULL").count() == 2
    empty = extra.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, FOLDER))
    assert empty.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert {m.__name__.rpartition(".")[2] for m in (byte_bpe, decontaminate, jaccard, secrets, toxicity)} == {
        "byte_bpe", "decontaminate", "jaccard", "secrets", "toxicity"
    }
