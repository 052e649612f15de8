"""Token operators against the libraries themselves."""
import base64
import random
from collections import defaultdict
from sys import getsizeof

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import bpe, packing, tokencount, tokenfile
from barloom.llm.units import TextEncoder, UnitCache, text_encoder

TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "Hello  world\n\n\tfoo's  'll bar", "don't 's\n's", "x" * 5000, "ab" * 3000 + " " + "\t" * 700, "é à ü ñ ŝ İ ſ",
    "foo <|endoftext|> bar  <|endoftext|>", "a\xa0 b\xa0  c d", "\x1c \x1f a\x85b", "▁a ▁▁ b", "<s> </s> <unk>", "\x00\x00 a\x00", "12345 67 8 ½ ²", "日本語 テキスト。 中文", "🙂🙂 a🙂",
    "é ́a", "".join(random.Random(1).choices("abc \n", k=3000)), "".join(random.Random(2).choices("thein ", k=20000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(7, "a b c", "x", "y", 1)] * 3 + [(None, "null id", None, None, None), (99, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, _text string, length int").repartition(3).cache()


def library(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_library_ids(name):
    encode = text_encoder(P.path(name))
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == library(name, text), text[:50]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_symbols_after_a_word_are_parted_from_it(name):
    """Such words go to the merges; the library's whole chain costs more than twice as much."""
    encode, asked = TextEncoder(P.path(name)), []
    whole = encode.library
    encode.library = lambda texts: asked.extend(texts) or whole(texts)
    for text in ("a Hothouse*** b", "x hothouse#%& $5 y", "hothouse&&&\nhothouse$ z", "don't* é***  a%'s b", "a*<|endoftext|*"):
        assert np.frombuffer(encode(text), "<u4").tolist() == library(name, text), text
    assert not any("hothouse" in x.lower() for x in asked)


def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENC = tiktoken_encoding()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab", max_size=300), st.text("theinao é", max_size=300)))
def test_tree_of_joins_gives_the_library_ids(text):
    own = bpe._text_bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert np.frombuffer(own(text), "<i4").tolist() == ENC.encode_ordinary(text)


def test_join_is_associative_over_any_cut():
    own = bpe._text_bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).bpe
    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choices(rng.choice(["ab", "thein", "étaionsr"]), k=rng.randint(2, 200))).encode()
        cut = rng.randint(0, len(data))
        assert own.join(own.merge(data[:cut]), own.merge(data[cut:])) == own.merge(data)


def test_encode_and_decode(docs):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    for got in (bpe.encode(docs, ranks, P.PATTERN, decoded=True), bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks)):
        rows = got.collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.decoded).decode()) for r in rows) == want
        assert all(r.ids == ENC.encode_ordinary(bytes(r.decoded).decode()) for r in rows)
    clash = bpe.decode(bpe.encode(docs, ranks, P.PATTERN).withColumn("decoded", F.lit(1)), ranks)
    assert clash.columns == ["doc_id", "ids", "decoded", "decoded_"] and clash.filter("decoded <> 1").count() == 0
    empty = bpe.encode(docs.limit(0), ranks, P.PATTERN, decoded=True)
    assert empty.count() == 0 and bpe.decode(bpe.encode(docs.limit(0), ranks, P.PATTERN), ranks).count() == 0


def test_workers_drop_units_of_other_operators(spark, docs):
    """Workers are used again: a stage that caches nothing doesn't run beside the units of one that did."""
    from barloom.llm.common import map_arrow

    def held(batches):
        from barloom.llm.units import UnitCache

        yield from ()
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(c.held) + len(c.old) for c in UnitCache.every)])], ["n"])

    assert packing.pack(docs, P.path("word_bpe_49k.json"), 2).count() > 0
    assert map_arrow(spark.range(8).repartition(8), held, "n bigint", caches=True).agg(F.max("n")).first()[0] > 0
    assert {r.n for r in map_arrow(spark.range(8).repartition(8), held, "n bigint").collect()} == {0}


def test_caches_share_one_budget(monkeypatch):
    """Long units, short units and two caches never hold more than the budget, and answers stay right."""
    monkeypatch.setattr(UnitCache, "every", type(UnitCache.every)())
    monkeypatch.setattr(UnitCache, "budget", 1 << 20)
    monkeypatch.setattr(UnitCache, "grown", 0)
    a, b = UnitCache(lambda units: [u.encode() for u in units]), UnitCache(lambda units: [len(u) for u in units])
    rng = random.Random(4)
    for k in range(300):
        units = ["w%d" % rng.randint(0, 20000) for _ in range(200)] + ["l%d" % k * rng.randint(1, 9000)]
        assert a.of(units) == [u.encode() for u in units] and (k % 3 or b.of(units) == [len(u) for u in units])
        held = [x for c in (a, b) for d in (c.held, c.old) for x in d.items()]
        assert sum(getsizeof(u) + getsizeof(v) for u, v in held) <= sum(c.held_bytes + c.old_bytes for c in (a, b)) <= (1 << 20) * 65 // 64 + 50_000  # a 64th and one batch more
    assert a.held and (a.old or b.old)


def test_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = tokencount.count(docs, P.path("piece_bpe_32k.model"), limit=1000).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1000) for r in got)
    assert tokencount.count(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_files(spark, docs):
    index = tokenfile.write(docs, P.path("byte_bpe_50k.json"), end_id=0)
    got = sorted(tokenfile.read(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda x: (x is not None, x or 0))
    at = 0
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*library("byte_bpe_50k.json", r.text or ""), 0], "<u4").tobytes())
    for r in got:
        assert r.start == at and bytes(r.ids) in want[r.doc_id] and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert tokenfile.read(tokenfile.write(docs.limit(0), P.path("byte_bpe_50k.json"), end_id=0)).count() == 0


def test_packing(spark, docs):
    pieces = packing.pack(docs, P.path("word_bpe_49k.json"), end_id=2, length=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert 0 < r.length <= 64 and len(r.ids) == 4 * r.length
    for r in docs.filter("doc_id <> 7 or doc_id is null").collect():
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist()
        assert ids == [*library("word_bpe_49k.json", r.text or ""), 2] and own[0].doc_tokens == len(ids)
    assert sum(r.length for r in by_doc[7]) == sum(len(library("word_bpe_49k.json", r.text)) + 1 for r in docs.filter("doc_id = 7").collect())
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json"), end_id=2).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 2000, 800)
    cost, size = defaultdict(float), defaultdict(int)
    for _, _, n, seq, _ in packing.plan(lengths):
        cost[seq] += n + n * n / 4096
        size[seq] += n
    full = [cost[s] for s in cost if size[s] == 4096]
    assert max(full) < 1.3 * min(full)
