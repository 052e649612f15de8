"""Document and embedding operators against brute force on small tables with every odd case."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barloom.llm import chunking, embeddings, lines, ppm, quality, simhash
from barloom.llm.common import components, spread_join
from barloom.llm.spans import later
from barloom.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hash string, _spans int, fp int, n int, digest string, word string"


def prose(rng, n, syllables=("tha", "ing", "éo", "re", "sto", "mi", "ka", "lu", "ba", "no")):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    shared, table = prose(rng, 60), "\n".join(prose(rng, 8) for _ in range(6))
    own = [prose(rng, int(rng.integers(80, 300))) for _ in range(30)]
    out = own + [own[0], own[1], own[1]]                                      # copies
    out += [own[k].replace(own[k].split()[40], "changed", 1) for k in (2, 3)]  # near copies
    out += [prose(rng, 70) + " " + shared + " " + prose(rng, 90 + k) for k in range(4)]
    out += [prose(rng, 20) + "\n" + prose(rng, 9) + "\n" + table + "\n" + prose(rng, 9) + "\n" + prose(rng, 20 + k) for k in range(3)]
    out += [None, "", " \n\t ", "a", "a b", "\n\n\n", "x " * 3000, ("line one\nline two\n" * 40), "é" * 4000, "A B c\ra\x0bb"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1, "h", 2, 3, 4, "d", "w") for i, t in texts]
    rows += [(None, texts[5][1], None, None, None, None, None, None, None, None, None)] + [(200, texts[6][1], "en", "s", 1, "h", 2, 3, 4, "d", "w")] * 5
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def linked(n, near):
    """Component of each of n things, as the least index."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def print_of(text, k=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [print_of(r.text) for r in rows]
    root = linked(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = defaultdict(list)
    for r, c in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[c].append(r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", min(least[c])) for r, p, c in zip(rows, prints, root, strict=True))
    got = simhash.near_groups(docs).select("_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert Counter(map(tuple, got)) == want
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "shard"), [(0, 8), (3, 30), (6, 120)])
def test_shards_lose_no_link(spark, radius, shard):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noisy = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6)).astype(np.uint64)) for b in base for _ in range(20)]
    prints = np.unique(np.concatenate([base, noisy]).astype(np.uint64)).view(np.int64)
    u = prints.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    want = linked(len(prints), lambda a, b: near[a, b])
    frame = materialize(spark.createDataFrame([(int(p),) for p in prints], "fp long"), "prints")
    # Small shards, so that they are divided.
    found = {r.node: r.root for r in components(simhash.links(frame, radius, shard=shard)).collect()}
    groups = defaultdict(set)
    for k, p in enumerate(prints):
        groups[found.get(int(p), int(p))].add(want[k])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want))


def test_tree_is_searched_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 20, 500, dtype=np.uint64)
    prints = np.unique(prints)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    want = linked(len(prints), lambda a, b: near[a, b])
    assert simhash.group(prints.reshape(-1, 1), 2).tolist() == want


def test_keep_one(docs):
    kept = simhash.keep_one(docs, simhash.near_groups(docs, 5, 3))
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert max(got.values()) == 1 and not got.keys() & {30, 31, 32, 200} and {0, 1, 4, 7, 20} <= got.keys()


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize(("shard", "members"), [(4096, 2048), (8, 2048), (4096, 3)])
def test_similar_groups(spark, shard, members):
    """Planted copies of every degree against all pairs: nothing is linked under 0.8, nearly all at 0.8 and all at 0.85 or more are."""
    rng = np.random.default_rng(6)
    rows, source = [], []
    for k in range(40):
        words = prose(rng, 200).split()
        for edits in (0, 1, 2, 3, 4, 4, 5, 5, 8, 12) if k else (0, 1) * 20:
            w = list(words)
            for at in rng.choice(200, edits, replace=False):
                w[at] = prose(rng, 1) + "x"
            rows.append((len(rows), " ".join(w), "clash"))
            source.append(k)
    n = len(rows)
    like = {(i, j): jaccard(rows[i][1], rows[j][1]) for i in range(n) for j in range(i) if source[i] == source[j]}
    want = linked(n, lambda a, b: like.get((a, b), 0) >= 0.8)
    rows += [(n, None, "clash"), (n + 1, "", "clash"), (None, "one two", "clash")] + [rows[50]] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string, _hash string").repartition(3)
    groups = simhash.similar_groups(frame, shard=shard, members=members).collect()
    got = {r._id: r.component_id for r in groups}
    assert len(groups) == len(rows) and got[n] == got[n + 1] == n and got[None] is None
    assert all(want[i] == want[got[i]] for i in range(n))
    bands = [(lo, [got[i] == got[j] for (i, j), s in like.items() if lo <= s < lo + 0.05]) for lo in (0.8, 0.85, 0.9, 0.95)]
    assert all(len(found) > 20 and np.mean(found) >= (1 if lo > 0.8 else 0.95) for lo, found in bands)
    assert sum(s < 0.8 and want[i] != want[j] for (i, j), s in like.items()) > 100
    assert simhash.similar_groups(frame.limit(0)).count() == 0


def test_verified_links_are_exact():
    """Labels against all pairs, with some sets linked before."""
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < keep], rng.integers(0, 1 << 62, more).astype(np.uint64)])) for b in base for keep, more in ((1, 0), (0.97, 0), (0.95, 3), (0.9, 6), (0.8, 1))]
    sets += [np.empty(0, np.uint64), sets[0][:48], sets[0]]
    prints = np.array([np.frombuffer(simhash.wide_fingerprint(x), "<u8") for x in sets])
    known = np.arange(len(sets)) + 100
    known[3] = known[27]
    like = lambda a, b: known[a] == known[b] or len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b]))) >= 0.8
    assert simhash.verified(prints, sets, known, 0.8).tolist() == linked(len(sets), like)


def test_quality(docs):
    led = {(r.doc_id, r.n_words): r for r in quality.ledger(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for d in range(3)}
        full = [x for x in text.split("\n") if WORD.search(x)]
        row = led[r.doc_id, len(words)]
        assert (row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered))
    kept = quality.filter_documents(docs, "base")
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in led.values() if not r.fail_bits & 3) + 4
    rules = {r.rule: r for r in quality.ablation(quality.ledger(docs), "v1").collect()}
    assert rules["few_words"].failed == sum(1 for r in quality.ledger(docs).collect() if r.n_words < 50)
    assert quality.ledger(docs.limit(0)).count() == 0


@pytest.mark.parametrize("op", [chunking, lines])
def test_repeats(docs, texts, op):
    """Against a plain pass in the order of (id, hash, position)."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("t")).distinct().collect()
    seen, gone = set(), defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        data = r.t.encode()
        if op is lines:
            pieces = [(a, b) for a, b, n in lines.chunks_of(data) if n >= 2 and data[a:b].strip()]
        else:
            ends = chunking.cuts(np.frombuffer(data, np.uint8), 0, len(data), chunking.borders(np.frombuffer(data, np.uint8)).tolist())
            pieces = list(zip([0, *ends], ends, strict=False))
        for a, b in pieces:
            body = data[a:b].rstrip(b"\n") if op is lines else data[a:b]
            if body in seen:
                if gone[r.doc_id, r.h] and gone[r.doc_id, r.h][-1][1] == a:
                    gone[r.doc_id, r.h][-1][1] = b
                else:
                    gone[r.doc_id, r.h].append([a, b])
            seen.add(body)
    least = chunking.LEAST if op is chunking else 0
    want = {}
    for r in keyed:
        spans = [s for s in gone[r.doc_id, r.h] if s[1] - s[0] >= least]
        data, at, rest = r.t.encode(), 0, b""
        for a, b in spans:
            rest, at = rest + data[at:a], b
        if spans:
            want[r.doc_id, r.h] = ((rest + data[at:]).decode(), spans)
    got = op.repeats(docs).collect()
    by_id = {r.doc_id: (r.text, [[s.start, s.stop] for s in r.spans]) for r in got}
    assert by_id == {k[0]: v for k, v in want.items()}
    assert len(got) == len(want) + (4 if 200 in by_id else 0)
    whole = op.deduplicate(docs)
    assert whole.columns == docs.columns and whole.count() == docs.count()
    for r in whole.collect():
        assert r.text == by_id[r.doc_id][0] if r.doc_id in by_id else r.text == dict(texts).get(r.doc_id, r.text)
    assert op.repeats(docs.limit(0)).count() == 0
    assert {36, 37, 38} <= by_id.keys() if op is chunking else {40, 41} <= by_id.keys()


def test_line_passages(spark):
    """Shared blocks of 2 to 10 lines go whole; against a plain pass over line pairs."""
    rng = np.random.default_rng(21)
    rows = []
    for k in range(60):
        block = [prose(rng, 9) for _ in range(2 + k % 9)]
        for _ in range(2):
            before, after = ([prose(rng, 9) for _ in range(int(rng.integers(0, 5)))] for _ in range(2))
            rows.append((len(rows), "\n".join([*before, *block, *after])))
    copies = list(rows)
    more = [None, "", "\n\n", "a\na\na\na\na", "one\ntwo\n" * 5, "own\n\n\nline\nx", "own\n\n\nline\ny", "z\nown\n\n\nline", "single\nq", "single\nr"]
    rows += [(1000 + k, t) for k, t in enumerate(more)] + [(None, rows[1][1]), (1003, more[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want, left = {}, {}, {}
    for i, t in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        parts, gone = re.split("(?<=\n)", t or ""), set()
        full = [j for j, x in enumerate(parts) if x.strip()]
        for at, (a, b) in enumerate(zip(full, full[1:], strict=False)):
            body = "".join(parts[a:b + 1]).removesuffix("\n")
            first = seen.setdefault(body, (i, at))
            if first != (i, at) and first != (i, at - 1):
                gone |= set(range(a, b + 1))
        left[i] = t if t is None else "".join(x for j, x in enumerate(parts) if j not in gone)
        if gone:
            want[i] = left[i]
    got = lines.passages(frame).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(k in want for k, _ in copies[1::2]) and left[1003] == "a\na\n" and left[1007] == "z\n" and left[1009] == "single\nr"
    whole = lines.without_passages(frame)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in whole.collect()))) == sorted(repr((i, left[i])) for i, _ in rows)
    assert lines.passages(frame.limit(0)).count() == 0


def test_bodies_under_one_digest(spark):
    """Different bodies under one digest have a first occurrence each."""
    rows = [(1, 0, 0, 4, 7, b"a"), (2, 0, 0, 4, 7, b"b"), (3, 0, 0, 4, 7, b"a"), (4, 0, 8, 12, 7, b"b"), (5, 0, 0, 4, 8, b"c"), (6, 0, 0, 4, 8, b"c"), (7, 0, 0, 4, 9, b"d")]
    frame = materialize(spark.createDataFrame(rows, "_id long, _hash long, start int, stop int, digest long, body binary"), "rows")
    assert sorted((r._id, r.first._id) for r in later(frame, len(rows), same=True).collect()) == [(3, 1), (4, 2), (6, 5)]


def pieces_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = chunking.cuts(data, 0, len(data), chunking.borders(data).tolist())
    return {data[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}


def test_shared_passages_are_found_after_insertions():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(200):
        passage = prose(rng, 55)
        a, b = (prose(rng, 40) + "!" * k + " " + passage + " " + prose(rng, 40) for k in (1, 8))
        missed += sum(map(len, pieces_of(a) & pieces_of(b))) < chunking.LEAST
    assert missed <= 4


def test_passages_go_whole(spark, monkeypatch):
    """Passages of 51 words of English length with one shared chunk go to their last byte; each byte that goes is somewhere before."""
    rng = np.random.default_rng(17)

    def words(n, end):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n)) + end
    rows, shared = [], {}
    for k in range(60):
        passage = "é" + words(51, "") + "ü"
        texts = [words(40, "#$"[j > 1] * j) + passage + "%&"[j > 1] + words(40, "") for j in (1, 8)]
        anchored = bool(pieces_of(texts[0]) & pieces_of(texts[1]))
        shared[2 * k + 1] = passage if anchored else None
        rows += [(2 * k + j, t) for j, t in enumerate(texts)]
    long, wide = words(900, ""), "".join(chr(0x4E00 + c) for c in rng.integers(0, 9000, 1500))
    rows += [(510, "A" + wide), (511, "BCD" + wide[:1300] + "x"), (512, words(40, "") + wide[100:] + "y")]
    rows += [(500, "A" + long), (501, "BC" + long), (502, None), (503, ""), (504, "ab" * 3000), (None, rows[1][1]), (501, "BC" + long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in chunking.passages(frame).collect()}
    assert sum(p is not None for p in shared.values()) >= 55
    texts = dict(rows)
    for i, p in shared.items():
        if p and i != 1:
            assert i in got and p not in got[i].text and len(texts[i].encode()) - len(got[i].text.encode()) >= len(p.encode()), i
            at = texts[i].encode().index(p.encode())
            assert [(s.start, s.stop) for s in got[i].spans] == [(at, at + len(p.encode()))]
    assert got[501].text == "BC" and got[1].text == "" and shared[1] not in got[0].text
    assert got[511].text == "BCDx" and got[512].text == texts[512].replace(wide[100:], "")
    monkeypatch.setattr(chunking, "REACH", 7)
    assert {r.doc_id: r.text for r in chunking.passages(frame).collect()} == {i: r.text for i, r in got.items()}
    whole = chunking.without_passages(frame)
    assert whole.count() == len(rows) and {r.doc_id: r.text for r in whole.collect()} == {i: got[i].text if i in got else t for i, t in texts.items()}
    assert chunking.passages(frame.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(30):
            c = rng.normal(size=16)
            for spread in (0, 0.02, 0.03, 0.05, 0.08):
                rows.append((k, [float(np.float32(x)) for x in c + spread * rng.normal(size=16)], label))
                k += 1
    rows += [(k, rows[3][1], 0), (k + 1, rows[3][1], 0), (k + 2, rows[3][1], 1), (k + 3, rows[3][1], None), (k + 4, None, 0), (k + 5, [0.0] * 16, 0), (k + 6, [float("nan")] * 16, 0),
             (k + 7, [], 0), (k + 8, [None] * 16, 0), (k + 9, [float("inf")] + [1.0] * 15, 0), (k + 10, [1.0, 2.0], 0), (k + 11, [1e-30] * 16, 2), (k + 12, [2e-30] * 16, 2), (None, rows[7][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    good = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]

    def near(a, b):
        if a not in ok or b not in ok or rows[a][2] != rows[b][2] or len(rows[a][1]) != len(rows[b][1]):
            return False
        x, y = (np.array(np.float32(rows[i][1]), np.float64) for i in (a, b))
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    ok = set(good)
    links = [sum(near(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    root = linked(len(rows), near)
    least = defaultdict(list)
    for (i, _, _), c in zip(rows, root, strict=True):
        least[c] += [] if i is None else [i]
    want = Counter((i, n, min(least[c], default=None), i == min(least[c], default=None)) for (i, _, _), n, c in zip(rows, links, root, strict=True))
    assert Counter(map(tuple, embeddings.near_vectors(frame).collect())) == want
    embeddings.BLOCK, block = 16, embeddings.BLOCK
    try:
        assert Counter(map(tuple, embeddings.near_vectors(frame).collect())) == want
    finally:
        embeddings.BLOCK = block
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_recall_of_tables():
    assert embeddings.tables_for(0.98, 8, 1.5, 0.9999) < 25
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(2000, 64))
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away
    a, b = rng.normal(size=(64, 8)), rng.uniform(0, 1.5, 8)
    hit = (np.floor((x @ a + b) / 1.5) == np.floor((y @ a + b) / 1.5)).all(axis=1).mean()
    assert abs(hit - embeddings.agreement(np.sqrt(0.04), 1.5) ** 8) < 0.04


def brute_ppm(train, order):
    """log10 code of a token by the same rules, over plain dictionaries; None stands for the end."""
    counts = Counter(w for doc in train for w in [*doc, None])
    total = sum(counts.values())
    trie = defaultdict(Counter)
    for w in counts:
        s = b" \n" if w is None else b" " + w + b" "
        for i in range(1, len(s)):
            for j in range(max(0, i - order), i + 1):
                trie[s[j:i]][s[i]] += 1

    def spelled(w):
        s, lp = (b" \n" if w is None else b" " + w + b" "), 0.0
        for i in range(1, len(s)):
            out = set()
            for j in range(max(0, i - order), i + 1):
                node = trie.get(s[j:i])
                if node is None:
                    continue
                left = {b: c for b, c in node.items() if b not in out}
                n, q = sum(left.values()), len(left)
                if s[i] in left:
                    lp += np.log10((2 * left[s[i]] - 1) / (2 * n))
                    break
                lp += np.log10(q / (2 * n)) if q else 0.0
                out = set(node)
            else:
                lp -= np.log10(252 - len(out))
        return lp
    once, twice = (sum(1 for w, c in counts.items() if c == k and w is not None) for k in (1, 2))
    cut = once / (once + 2 * twice) if once and twice else 0.5
    free = 1 - sum(10 ** spelled(w) for w in counts)

    def lp(w):
        return np.log10((counts[w] - cut) / total) if w in counts else np.log10(cut * len(counts) / total) - np.log10(free) + spelled(w)
    return counts, total, lp


@pytest.mark.parametrize("events", [None, 0])
def test_ppm(docs, monkeypatch, events):
    if events is not None:
        monkeypatch.setattr(ppm, "EVENTS", events)
        monkeypatch.setattr(ppm, "FREQUENT", 20)
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    rows = docs.select("doc_id", "text", training.alias("t")).collect()
    tokens = [(r.text or "").encode().lower().split() for r in rows]
    counts, total, lp = brute_ppm([w for w, r in zip(tokens, rows, strict=True) if r.t], ppm.ORDER)
    want = defaultdict(list)
    for r, w in zip(rows, tokens, strict=True):
        base = sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in [*w, None])
        want[r.doc_id].append((r.t, len(w) + 1, sum(x in counts for x in [*w, None]), total, base, sum(lp(x) for x in [*w, None])))
    got = ppm.score(docs, training).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    for r in got:
        near = want[r.doc_id][0]
        assert tuple(r)[1:5] == near[:4]
        assert tuple(r)[5:] == pytest.approx(near[4:], rel=1e-9)


def test_ppm_is_a_distribution(spark):
    """All one-byte words, longer words by their first byte, and the end: the trie's codes of the first symbol sum to one."""
    _, _, lp = brute_ppm([[b"ab", b"a", b"b"], [b"ab"]], ppm.ORDER)
    assert lp(b"ab") > lp(b"a") > lp(b"zq")
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_ppm_without_training(spark):
    rows = ppm.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert {r.n_tokens: round(r.score, 6) for r in rows} == {3: round(-5 * np.log10(252), 6), 1: round(-np.log10(252), 6)}


def test_spread_join_and_components(spark):
    rows = materialize(spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    keyed = materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "keyed")
    joined = spread_join(rows, keyed, "k", "n", 3000)
    assert joined.count() == 3000 and joined.filter("k = 0").agg(F.max("top"), F.count("*")).first()[:] == (999, 1000)
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 102)], "a long, b long"))
    assert {r.node: r.root for r in components(chain).collect()} == {**{k: 0 for k in range(1, 61)}, 101: 100, 102: 100}
