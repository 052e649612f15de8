"""Language profiles against loops over single grams, and held-out accuracy."""
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import langid
from barloom.llm.queries import op11_language_id

SCHEMA = "doc_id long, text string, lang string, _id int, training string, lang_pred string, score string"
WORDS = {"xx": "the thing that bathes othering those".split(), "yy": "sol luna çaé über mañana".split(), "zz": "ждать жизнь 日本語 зима".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang], rng.integers(1, 40))), lang) for i, lang in enumerate(list(WORDS) * 20)]
    rows += [(100, None, "xx"), (101, "", "yy"), (102, " 12 !? \n", "zz"), (103, "a", None), (104, "A1B  c--d", "xx"), (105, "ж" * 5000, "zz"), (106, "the sol " * 4000, "xx"), (None, "no id", "yy"), (107, "İstanbul \U00020000", "yy")]
    rows += [(200, "the same", "xx")] * 5
    return spark.createDataFrame([(*r, 1, "t", "p", "s") for r in rows], SCHEMA).repartition(3).cache()


def slow_bundle(text, dimensions):
    word, total = "".join(c if c.isalpha() else " " for c in (text or "").lower()), np.zeros(dimensions)
    if not word.strip():
        return total
    symbols = [0] + [0 if c == " " else ord(c) for c in " ".join(word.split())] + [0]
    for x, y, z in zip(symbols, symbols[1:], symbols[2:], strict=False):
        total += np.roll(langid.letter_vector(x, dimensions), 2).astype(int) * np.roll(langid.letter_vector(y, dimensions), 1) * langid.letter_vector(z, dimensions)
    return total


def test_identify(docs):
    training, size = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1, 256
    rows, sums = docs.collect(), defaultdict(lambda: np.zeros(256))
    for r in rows:
        own = slow_bundle(r.text, size)
        if (r.doc_id or 0) % 3 != 1 and r.lang and own.any():
            sums[r.lang] += np.rint(own * (langid.SCALE / np.sqrt(own @ own)))
    names = sorted(sums)
    want = []
    for r in rows:
        own = slow_bundle(r.text, size)
        cos = [own @ sums[n] / np.sqrt(own @ own) / np.sqrt(sums[n] @ sums[n]) for n in names] if own.any() else []
        want.append((r.doc_id is not None, r.doc_id or 0, (r.doc_id or 0) % 3 != 1, names[int(np.argmax(cos))] if cos else "und", round(min(1, max([0, *cos])), 9)))
    got = langid.identify(docs, training, dimensions=size)
    assert got.columns == ["doc_id", "training", "lang_pred", "score"]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.training, r.lang_pred, round(r.score, 9)) for r in got.collect()) == sorted(want)
    assert langid.identify(docs.limit(0), training).count() == 0


def test_nothing_learned(docs):
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == docs.count()


def test_partitioning_changes_nothing(docs):
    rows = lambda d: sorted(map(str, langid.identify(d, F.lit(True)).collect()))
    assert rows(docs) == rows(docs.repartition(7))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op11_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 250 and np.mean([r.lang == r.lang_pred for r in got]) > 0.99
