"""The pipeline's stages, each against the operator's verdicts on that stage's own input."""

import zlib

import corpus_pipeline
import numpy as np
from sphaera.llm import queries, rules, secrets
from tokenizers import Tokenizer

from tests.llm.test_queries import linked_components, shingle_set


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    verdicts = {r.doc_id: r.kept for r in rules.measures(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert set(kept[0]) == {i for i in start if verdicts[i]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = [i for i in kept[0] if i in labels]
    assert sum((i in kept[1]) == bool(labels[i]) for i in known) >= 0.97 * len(known)
    assert set(kept[2]) == set(linked_components({i: shingle_set(t) for i, t in kept[1].items()}).values())
    assert kept[3] == {i: secrets.redacted(t) for i, t in kept[2].items()} and kept[3] != kept[2]
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in kept[3].items()}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(p.length for p in packed) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in packed)
