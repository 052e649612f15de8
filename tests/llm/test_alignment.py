"""Cross-tokenizer alignment against the libraries and plain loops over bytes."""
import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from barloom.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "Hello  world\n\n\tfoo's bar", "Hello world", "Hello world", "x" * 5000, "é à ü ñ ŝ İ ſ 日本語 🙂🙂", "foo <|endoftext|> bar",
    "▁a ▁▁ b", "<s> </s> <unk>", "\x00\x00 a\x00", "12345 67 8 ½", "the theatre thematic " * 400, "<0x41> á", "a\xa0b c", "tha ingéo restomi " * 30 + "end",
]
SCHEMA = "doc_id long, text string, n_a int, _key string, _copies int, pair string, a int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", 2, "p", 3) for i, t in enumerate(TEXTS)] + [(100 + i, "Hello world again", 1, "k", 2, "p", 3) for i in range(80)]
    return spark.createDataFrame(rows + [(None, "null id", None, None, None, None, None)] * 2, SCHEMA).repartition(3).cache()


def brute(rows):
    """Everything by loops over token byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    shown = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    for k, b in enumerate(x for x in range(256) if chr(x) not in shown):
        shown[chr(256 + k)] = b
    docs = []
    for r in rows:
        data = (" " + (r.text or "")).encode()
        a = [(i, bytes(shown[c] for c in tok.id_to_token(i))) for i in tok.encode(data.decode(), add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(r.text or "")]
        if not r.text or any(b"".join(t for _, t in side) != data for side in (a, b)):
            a = b = []
        docs.append((a, b))
    ranged = lambda side: [(i, end - len(t), end) for (i, t), end in zip(side, [sum(len(u) for _, u in side[:k + 1]) for k in range(len(side))], strict=True)]
    links, out = [], []
    for a, b in docs:
        ra, rb = ranged(a[:]) if len(a) < 3000 else [], ranged(b[:]) if len(a) < 3000 else []
        links.append([(i, j) for i, x, y in ra for j, u, v in rb if max(x, u) < min(y, v)])
        groups, ends = [], sorted({y for _, _, y in ra} & {v for _, _, v in rb})
        for lo, hi in zip([0, *ends], ends, strict=False):
            groups.append(",".join(str(i) for i, _, y in ra if lo < y <= hi) + "|" + ",".join(str(j) for j, _, v in rb if lo < v <= hi))
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(p for one in links for p in set(one))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(r.doc_id, na, nb, g, len(one), sum(count[p] == best[p[0]] for p in one), sum(count[p] for p in one), sha)
            for r, (na, nb, g, sha), one in zip(rows, out, links, strict=True)]


@pytest.mark.parametrize("frequent", [1, 40, 1 << 20])
def test_alignment(docs, frequent):
    key = lambda r: (r[0] is not None, r)
    want = sorted(brute(docs.collect()), key=key)
    got = alignment.cross_align(docs, A, B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 90


def test_empty(docs):
    assert alignment.cross_align(docs.limit(0), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.cross_align(docs.filter("text is null or text = ''"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
