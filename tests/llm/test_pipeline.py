"""The pipeline's stages on the smallest table: columns, decisions, and the last stage against the tokenizer."""

import hashlib

import corpus_pipeline
import public_tokenizers as vocabularies
from tokenizers import Tokenizer

from plexmat.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        got = {r["doc_id"] for r in docs.collect()}
        assert got and got <= set(kept)
        kept = {i: kept[i] for i in got}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    expected = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, library.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in last) == expected


def test_queries_are_named(spark):
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
