"""Texts as units that a tokenizer treats independently, and worker caches over them.

A public tokenizer's merges never cross certain borders (white space). Between such
borders equal strings have equal ids, so each worker encodes a unit once.
"""

from __future__ import annotations

import json
import re
import weakref
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from string import ascii_letters
from sys import getsizeof
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that all unit caches of a worker hold together, and bytes of text worked on at once.
CACHE_BYTES = 448 << 20
BLOCK_BYTES = 4 << 20
# What an entry of a dictionary takes beside its key and value.
SLOT_BYTES = 96

# White space beyond ASCII and separators on which libraries differ: such texts go to the library whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
# Runs of white space that reach over a space, where splitting at single spaces would part them.
ACROSS = re.compile(r"[\t-\r] [\t-\r]")
BEFORE = ("\n ", "\t ", "\r ", "\x0b ", "\x0c ")
# With ASCII white space only: a word with the space before it; a run of white space but for its last character before a word; that character.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Marks that are split off the end of a word that ends in an ASCII letter.
MARKS, LETTERS = ".,;:!?*$&#%", frozenset(ascii_letters)
# Words between ASCII white space.
BARE = re.compile(r"[^\x20\x09-\x0D]+")


def bytes_of(entries: dict) -> int:
    return sum(map(getsizeof, entries)) + sum(map(getsizeof, entries.values())) + SLOT_BYTES * len(entries)


class UnitCache:
    """unit -> value, filled by encode_many(units), in two generations of a share of the worker's budget.

    All caches of a worker draw on one budget in bytes. When newer generations take over half of it, the largest ages:
    it becomes the older one, what is used again stays; older generations go when all take more than the budget. A unit
    that alone takes more than a 64th of the budget is encoded each time.
    """

    every: weakref.WeakSet[UnitCache] = weakref.WeakSet()
    budget, grown = CACHE_BYTES, 0

    def __init__(self, encode_many: Callable[[list[str]], Iterable]):
        self.held: dict = {}
        self.old: dict = {}
        self.held_bytes = self.old_bytes = 0
        self.encode_many = encode_many
        UnitCache.every.add(self)

    def of(self, units: list[str]) -> list:
        values = list(map(self.held.get, units))
        if None in values:
            gaps = [i for i, v in enumerate(values) if v is None]
            new = dict.fromkeys(units[i] for i in gaps)
            unknown = []
            for u in new:
                if (v := self.old.get(u)) is None:
                    unknown.append(u)
                else:
                    new[u] = v
            if unknown:
                new.update(zip(unknown, self.encode_many(unknown), strict=True))
            for i in gaps:
                values[i] = new[units[i]]
            self.keep(new)
        return values

    def keep(self, new: dict) -> None:
        most = self.budget // 64
        if (size := bytes_of(new)) > most:
            new = {u: v for u, v in new.items() if getsizeof(u) + getsizeof(v) + SLOT_BYTES <= most}
            size = bytes_of(new)
        self.held.update(new)
        self.held_bytes += size
        UnitCache.grown += size
        if UnitCache.grown > most:
            UnitCache.settle()

    @classmethod
    def release(cls) -> None:
        """Let go of all units of this worker."""
        for c in cls.every:
            c.held, c.old, c.held_bytes, c.old_bytes = {}, {}, 0, 0

    @classmethod
    def settle(cls) -> None:
        """Bring all caches under the budget again; called each time that they have grown by a 64th of it."""
        cls.grown = 0
        while sum(c.held_bytes for c in cls.every) > cls.budget // 2:
            aged = max(cls.every, key=lambda c: c.held_bytes)
            aged.old, aged.held = aged.held, {}
            aged.old_bytes, aged.held_bytes = aged.held_bytes, 0
        while sum(c.held_bytes + c.old_bytes for c in cls.every) > cls.budget:
            oldest = max(cls.every, key=lambda c: c.old_bytes)
            oldest.old, oldest.old_bytes = {}, 0


def byte_alphabet() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


def letters_are_whole(tok) -> bool:
    """Byte-level merges over runs of letters, with no other changes than composed characters and lower case."""
    said = json.loads(tok.to_str())
    steps = (said["normalizer"] or {"normalizers": []}).get("normalizers", [{"type": "?"}])
    before = said["pre_tokenizer"] or {}
    before = before.get("pretokenizers", [before])
    splits = any(x.get("use_regex") for x in before) or r"[\p{L}]+" in json.dumps(before).replace("\\\\", "\\")
    return said["model"]["type"] == "BPE" and before[-1].get("type") == "ByteLevel" and splits and {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"}


def odd(text: str) -> bool:
    return any(c in text for c in (ODD_SPACE[:4] if text.isascii() else ODD_SPACE))


class Spaced:
    """Byte-level texts as words with the space before them; equal words have equal ids wherever they stand."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]]):
        self.units = UnitCache(encode_many)
        self.after = UnitCache(lambda words: encode_many([" " + w for w in words]))

    def __call__(self, text: str) -> bytes:
        """A text without odd white space."""
        if "  " in text or text[-1:] == " " or (any(b in text for b in BEFORE) and ACROSS.search(text)):
            return b"".join(self.units.of(SPACED.findall(text)))
        words = text.split(" ")
        first = self.units.of(words[:1]) if words[0] else []
        return b"".join(first + self.after.of(words[1:]))


class TextEncoder:
    """Whole texts to little-endian unsigned 32-bit ids as a tokenizers file gives them, without added special tokens.

    With ``plain``, special strings inside texts are text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        self.specials = [] if plain else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.vocab_size = self.tok.get_vocab_size()
        probe = [self.tok.encode(x, add_special_tokens=False).ids for x in ("a  b\n c", "a b c")]
        self.drops_spaces = probe[0] == probe[1]
        probe = [self.tok.encode(x, add_special_tokens=False).ids for x in ("Ab", "ab")]
        self.drops_case = probe[0] == probe[1]
        self.model, self.alphabet = (self.tok.model, byte_alphabet()) if letters_are_whole(self.tok) else (None, None)
        self.space = chr(byte_alphabet()[0x20])
        self.parts = UnitCache(self.by_letters)
        self.cache = UnitCache(self.by_parts)
        self.spaced = Spaced(self.by_parts)

    def by_letters(self, parts: list[str]) -> list[bytes]:
        """Parts of letters only go to the merges at once, all others to the library's whole chain."""
        if self.model is None:
            return self.library(parts)
        out, rest, merges, spaced, cased = [], [], self.model.tokenize, not self.drops_spaces, self.drops_case
        for part in parts:
            letters = part[1:] if spaced and part[:1] == " " else part
            if letters.isalpha() and (not cased or (part.islower() and part.lower() == part and is_normalized("NFC", part))):
                if not part.isascii():
                    shown = part.encode().decode("latin-1").translate(self.alphabet)
                elif letters is part:
                    shown = part
                else:
                    shown = self.space + letters
                out.append(array("I", [t.id for t in merges(shown)]).tobytes())
            else:
                out.append(None)
                rest.append(part)
        found = iter(self.library(rest) if rest else ())
        return [next(found) if x is None else x for x in out]

    def by_parts(self, units: list[str]) -> list[bytes]:
        """Units as words, and words as a core and the marks after its last letter, which the library splits too."""
        parts, sizes, cased = [], [], self.cased if self.drops_case else None
        for unit in units:
            words = SPACED.findall(unit) if "\n" in unit else (unit,)
            before = len(parts)
            for word in words:
                core = word.rstrip(MARKS)
                if len(core) == len(word) or core[-1:] not in LETTERS:
                    parts.append(cased(word) if cased else word)
                else:
                    parts += cased(core) if cased else core, word[len(core):]
            sizes.append(len(parts) - before)
        found, at, out = self.parts.of(parts), 0, []
        for n in sizes:
            out.append(found[at] if n == 1 else b"".join(found[at : at + n]))
            at += n
        return out

    def cased(self, word: str) -> str:
        return word.lower() if self.drops_case and word.isascii() and "<|" not in word else word

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        strange = odd(text)
        if self.drops_spaces:
            return b"".join(self.cache.of(BARE.findall(text) if strange else text.split()))
        if strange or any(s in text for s in self.specials):
            return self.library([text])[0]
        return self.spaced(text)


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One per worker and file."""
    return TextEncoder(path)


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of a string column at most (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(sizes):
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.binary())
