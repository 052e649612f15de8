"""The pipeline's stages on a small table: what each keeps, drops and returns."""
import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import quality
from barloom.llm.units import text_encoder
from barloom.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_hash", F.lit("clash"))
    before = docs.count()
    # A hot copy, a planted near copy, and a passage of over 50 words in another text.
    rows = docs.orderBy(F.length("text").desc()).limit(20).collect()
    words = rows[0].text.split(" ")
    near = " ".join([*words[:30], "changed", *words[31:]])
    passage = " ".join(rows[1].text.split(" ")[100:170])
    fresh = " ".join(f"{a}{b}" for a, b in zip(rows[2].text.split(" ")[:120], rows[3].text.split(" ")[1:121], strict=True))
    more = [(10**6 + k, rows[0].text, "en", "s", 1, "clash") for k in range(30)] + [(2 * 10**6, near, "en", "s", 1, "clash"), (3 * 10**6, f"{fresh} {passage} {fresh[::-1]}", "en", "s", 1, "clash"),
            (4 * 10**6, None, "en", "s", 1, "clash"), (None, fresh.upper(), None, None, None, "clash")]
    docs = materialize(docs.unionByName(spark.createDataFrame(more, docs.schema)), "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0, name
        if name == "quality rules":
            bad = {r.doc_id for r in quality.ledger(docs).filter("fail_bits <> 0").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad and len(bad) < before / 3
        docs = out
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not any(k and 10**6 <= k < 2 * 10**6 for k in left)
    assert len(left.get(2 * 10**6, '')) < 400
    assert passage not in left[3 * 10**6] and left[3 * 10**6].startswith(fresh[:-200]) and None in left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encode = text_encoder(P.path("word_bpe_49k.json"))
    want = {k: len(np.frombuffer(encode(t), "<u4")) + 1 for k, t in left.items()}
    got: dict = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


def test_registered_queries():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
