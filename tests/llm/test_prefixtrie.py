"""The conversation trie against plain dictionaries of prefixes."""
import hashlib
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import prefixtrie
from barloom.llm.queries import own_after, shared_base

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, depth string, block int"


def brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            own[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [k for k in out if len(k) == len(node) + 1 and k[:-1] == node]
        saved = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), sum(out[k][5] for k in kids) or 1,
                     saved + sum(out[k][6] for k in kids), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def turns(spark):
    rng = np.random.default_rng(3)
    say = lambda: " ".join(rng.choice(["yes", "no", "tha ing", "é\n"], rng.integers(0, 4)))
    rows = [(c, t if t else None, str(rng.choice(["user", "bot"])), say()) for c in range(0, 130) for t in range(rng.integers(1, 6)) if c % 33]
    rows += [(500, t, "user", "same") for t in range(60)] + [(521, t, "user", "same") for t in range(57)]        # long, and one the other's beginning
    rows += [(c, t, "user", f"copy {t}") for c in range(600, 660) for t in range(3)]                               # copies
    rows += [(700 + 20 * k, t, "user", f"tail {k}" if t else "shared start") for k in range(40) for t in range(3)]  # one parent of many
    rows += [(5000, 1, None, None), (5000, 2, "", ""), (5001, 1, "", ""), (None, 1, "user", "lost"), (5003, 7, "a", "bc"), (5004, 7, "ab", "c"), (5005, 3, "x", "twice"), (5005, 3, "x", "twice")]
    return spark.createDataFrame([(*r, "k", 1, "d", 2) for r in rows], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize(("part", "block"), [(1 << 18, 1 << 18), (7, 9)])
def test_trie(turns, part, block):
    got = prefixtrie.trie(turns, own_after(), shared_base(), part, block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == brute(turns.collect())


def test_empty(turns):
    assert prefixtrie.trie(turns.limit(0), own_after(), shared_base()).count() == 0
    assert prefixtrie.trie(turns.filter("conv_id is null"), own_after(), shared_base()).count() == 0
    assert [tuple(r) for r in prefixtrie.trie(turns.filter("conv_id = 5001"), own_after(), shared_base()).collect()] == brute(turns.filter("conv_id = 5001").collect())


def test_no_shared_start(turns):
    """Without a base, every conversation keeps its own turns."""
    got = prefixtrie.trie(turns, F.lit(0), F.col("conv_id"))
    assert got.filter("depth = 60").select("conv_id").collect() == [(500,)]
