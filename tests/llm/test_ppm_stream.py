"""Byte-stream scores against a plain model: every context as a dictionary of counts."""
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ppm


def plain(train, order):
    seen = defaultdict(Counter)
    for s in train:
        for t in range(1, len(s)):
            for k in range(min(t, order) + 1):
                seen[s[t - k:t]][s[t]] += 1

    def lp(context, symbol):
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            own = {x: c for x, c in seen[context[len(context) - k:]].items() if x not in gone} if context[len(context) - k:] in seen else {}
            n = sum(own.values())
            if symbol in own:
                return out + np.log10((2 * own[symbol] - 1) / (2 * n))
            if own:
                out += np.log10(len(own) / (2 * n))
            gone |= own.keys()
        return out - np.log10(ppm.ALPHABET - len(gone))
    return lambda s: sum(lp(s[max(0, t - order):t], s[t]) for t in range(1, len(s))), lp


@pytest.mark.parametrize("events", [None, 25])
def test_every_byte_is_predicted(spark, monkeypatch, events):
    rows = [(k, t) for k, t in enumerate(["the cat saw the dog", "the dog saw the cat", "a  Cat\tand a dog\n", "", None, "saw the", "zq ü the cat", "the cat saw the dog", "x" * 40, "cat the saw dog the"])]
    train = lambda k: k % 5 not in (1, 4) and k < 9
    streams = {k: ppm.stream_of((t or "").encode()) for k, t in rows}
    score, lp = plain([s for k, s in streams.items() if train(k)], ppm.ORDER)
    for context in (b"", b" ", b" the ", b"e cat", b"dog", b"never"):
        symbols = [x for x in range(256) if x not in (9, 11, 12, 13)]
        assert sum(10 ** lp(context, x) for x in symbols) <= 1 + 1e-9
    if events:
        monkeypatch.setattr(ppm, "EVENTS", events)
        monkeypatch.setattr(ppm, "FREQUENT", 3)
        monkeypatch.setattr(ppm, "PIECE", 7)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    training = (F.col("doc_id") % 5 != 1) & (F.col("doc_id") % 5 != 4) & (F.col("doc_id") < 9)
    got = {r.doc_id: r for r in ppm.stream_scores(frame, training).collect()}
    assert {k: r.score for k, r in got.items()} == pytest.approx({k: score(s) for k, s in streams.items()}, rel=1e-9)
    old = {r.doc_id: r for r in ppm.score(frame, training).collect()}
    assert all(tuple(got[k])[1:5] == tuple(old[k])[1:5] and got[k].base_score == pytest.approx(old[k].base_score) for k in old)
    assert got[0].score > got[9].score and abs(old[0].score - old[9].score) < 1e-9  # the same words in another order


def test_edges(spark):
    schema = "doc_id long, text string"
    assert ppm.stream_scores(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = ppm.stream_scores(spark.createDataFrame([(1, "a b"), (2, None)], schema), F.lit(False)).collect()
    assert {r.n_tokens: round(r.score, 6) for r in rows} == {3: round(-5 * np.log10(252), 6), 1: round(-np.log10(252), 6)}
