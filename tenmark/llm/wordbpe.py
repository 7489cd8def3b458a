"""Word-level byte pair encoding with a whole-token shortcut.

The vocabularies meant here lower-case a text, drop its white space, split it into pre-tokens and merge
each pre-token alone. So a vocabulary string that is one pre-token and encodes to one id does so in every
text. ``Segmenter`` proves that offline, once per process, for every string of the vocabulary; pre-tokens
found among them are taken directly and only the rest are merged.

The pattern below holds for characters whose class and case are the same in every Unicode version. A run
between spaces that has any other character goes to the library itself, which also keeps texts with the
strings of special tokens exact. Pre-tokens are found as spans, told apart by hash and bytes, and looked up once
a batch. What they came to is remembered, about ``REMEMBERED`` of them besides those of the batch in work. New ones
are merged as arrays, many at once; a vocabulary that merges in another way than ``_Merges`` sends them to the
library.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Collection

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from .common import resident
from .shingles import span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
REMEMBERED = 800_000
PIECE = 1 << 19
#: ASCII, accented Latin letters and common punctuation: no composition applies to them, and lower() maps each alone.
_PLAIN = "\t\n\r\x20-\x7e¡«»¿À-įı-ňŊ-ſ–—‘’“”…€"
_ODD = re.compile(f"[^{_PLAIN}]")
_LETTER = "a-zß-öø-ÿĀ-ſ"
#: The contractions that the vocabulary's pre-tokenizer splits off.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
_SPACE = re.compile("[ \t\n\r]+")
_BLANK, _ALPHA, _OTHER, _DIGIT, _LATER = range(5)
#: The class of each byte in lower-case plain text; letters beyond ASCII begin with 0xC3 to 0xC5, what follows in a character is _LATER.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 13, 32]] = _BLANK
_KIND[[*range(97, 123), 0xC3, 0xC4, 0xC5]] = _ALPHA
_KIND[48:58] = _DIGIT
_KIND[0x80:0xC0] = _LATER


class Segmenter:
    """Ids or counts of whole texts, equal to the library's."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        suffix = self.library.model.end_of_word_suffix or ""
        self.merges = _Merges.of(self.library)
        self.proven = self._prove([w.removesuffix(suffix) for w in vocabulary if w.endswith(suffix)])
        self.pieces = _Remembered(REMEMBERED, self.proven)  # pre-tokens
        self.odd = _Remembered(REMEMBERED // 10, {})  # runs with other characters, as they stand

    def _prove(self, words: list[str]) -> dict[bytes, bytes]:
        """Vocabulary strings that are one pre-token and encode alone as one id."""
        words = [w for w in words if w and not _ODD.search(w) and w == w.lower() and (m := _PRE.match(w)) and m.end() == len(w)]
        found = self.library.encode_batch(words, add_special_tokens=False)
        return {w.encode(): struct.pack("<I", e.ids[0]) for w, e in zip(words, found, strict=True) if len(e.ids) == 1}

    def _alone(self, strings: list[str]) -> list[bytes]:
        """The library's ids of each string."""
        found = self.library.encode_batch_fast(strings, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for e in found for ids in (e.ids,)]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are no whole token."""
        return self.merges.ids(pieces) if self.merges else self._alone([p.decode() for p in pieces])

    def _of_plain(self, texts: list[str], ids: bool) -> list:
        """Ids, or their number, of texts of plain characters: each different pre-token of a batch is looked up once."""
        coded = [t.lower().encode() for t in texts]
        data = b"\n".join(coded)
        starts, ends = pre_tokens(data)
        if not len(starts):
            return [b"" if ids else 0 for _ in texts]
        code, different = pd.factorize(span_hashes(data, starts, ends))
        first = np.empty(len(different), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if not _same_bytes(data, starts, ends, first[code]):  # two pre-tokens of one hash
            code = first = np.arange(len(starts))
        keys = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = list(map(self.pieces.all_of(keys, self._merged).__getitem__, keys))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        whole = np.r_[0, np.cumsum(sizes[code])]  # ids before each pre-token
        cuts = whole[np.r_[0, np.searchsorted(starts, np.cumsum([len(c) + 1 for c in coded]))]]
        if not ids:
            return np.diff(cuts).tolist()
        pool, base = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        out = pool[np.repeat(base[code] - whole[:-1], sizes[code]) + np.arange(whole[-1])].tobytes()
        cuts = (4 * cuts).tolist()
        return [out[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def _of_odd(self, text: str) -> bytes:
        """Ids of a text some of whose runs go to the library."""
        runs = _SPACE.split(text)
        strange = [bool(_ODD.search(r)) or any(s in r for s in self.special) for r in runs]
        odd = self.odd.all_of({r for r, x in zip(runs, strange, strict=True) if x}, self._alone)
        plain = iter(self._of_plain([r for r, x in zip(runs, strange, strict=True) if not x], True))
        return b"".join(odd[r] if x else next(plain) for r, x in zip(runs, strange, strict=True))

    def _batch(self, texts: list[str], ids: bool) -> list:
        odd = {k for k, t in enumerate(texts) if _ODD.search(t) or any(s in t for s in self.special)}
        plain = iter(self._of_plain([t for k, t in enumerate(texts) if k not in odd], ids))
        other = lambda data: data if ids else len(data) // 4
        return [other(self._of_odd(t)) if k in odd else next(plain) for k, t in enumerate(texts)]

    def _all(self, texts: list[str], ids: bool) -> list:
        """Batches of about ``PIECE`` characters; longer texts go in cuts at white space."""
        out, held, size = [], [], 0
        for text in texts:
            if held and size + len(text) > PIECE:
                out += self._batch(held, ids)
                held, size = [], 0
            if len(text) > PIECE:
                parts = (self._batch([part], ids)[0] for part in _cuts(text))
                out.append(b"".join(parts) if ids else sum(parts))
            else:
                held.append(text)
                size += len(text) + 1
        return out + self._batch(held, ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as unsigned little-endian 32-bit numbers."""
        return self._all(texts, True)

    def counts(self, texts: list[str]) -> list[int]:
        return self._all(texts, False)


def pre_tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of lower-case plain text start and end: what ``_PRE`` finds, as arrays.

    Runs of one class of characters are tokens, but digits stand alone, and an apostrophe by itself takes the
    letters of a contraction that follow it.
    """
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(data, np.uint8)
    kind = _KIND[a]
    for _ in range(2):  # the second and third byte of a character are of its class
        later = np.flatnonzero(kind == _LATER)
        kind[later] = kind[later - 1]
    signs = np.flatnonzero((a[:-1] == 0xC3) & ((a[1:] == 0x97) | (a[1:] == 0xB7)))  # multiplication and division
    kind[signs] = kind[signs + 1] = _OTHER
    starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)])
    ends = np.r_[starts[1:], len(a)]
    marks = np.flatnonzero((a[starts] == 0x27) & (ends - starts == 1) & np.r_[kind[starts[1:]] == _ALPHA, False])
    if len(marks):
        x = a[ends[marks]]
        y = np.where(ends[marks + 1] - ends[marks] > 1, a[np.minimum(ends[marks] + 1, len(a) - 1)], 0)
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        take = np.where(one, 1, np.where(two, 2, 0))
        ends[marks] += take
        starts[marks + 1] += take
    keep = (starts < ends) & (kind[np.minimum(starts, len(a) - 1)] != _BLANK)
    return starts[keep], ends[keep]


def _same_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> bool:
    """Whether each span of ``data`` equals the span of number ``first``."""
    sizes = ends - starts
    if not np.array_equal(sizes, sizes[first]):
        return False
    a, before = np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes
    every = np.arange(int(sizes.sum()))
    return bool((a[every + np.repeat(starts - before, sizes)] == a[every + np.repeat(starts[first] - before, sizes)]).all())


class _Merges:
    """Byte pair merges of many pre-tokens at once, as arrays.

    In each round every pre-token merges its pair of lowest rank wherever it stands, from the left. This is what
    merging one pair after the other comes to, since a merge can only make pairs of higher rank than its own.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        letters = {x: chr(x) for x in same} | {x: chr(256 + k) for k, x in enumerate(sorted(set(range(256)) - set(same)))}
        self.inner = np.array([vocabulary[letters[x]] for x in range(256)], np.int64)
        self.final = np.array([vocabulary[letters[x] + suffix] for x in range(256)], np.int64)
        pairs = np.array([vocabulary[x] << 32 | vocabulary[y] for x, y in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank = np.r_[pairs[order], np.iinfo(np.int64).max], np.r_[order, len(pairs)]
        self.made = np.array([vocabulary[x + y] for x, y in merges], np.int64)
        if len(set(pairs.tolist())) != len(pairs) or any(max(places) > rank for rank, places in self._sources(pairs).items()):
            raise ValueError("a pair is merged before its parts are made")

    def _sources(self, pairs: np.ndarray) -> dict[int, list[int]]:
        """For each merge the ranks of the merges that make its parts."""
        made = {x: rank for rank, x in enumerate(self.made.tolist())}
        return {rank: [made.get(p >> 32, -1), made.get(p & 0xFFFFFFFF, -1)] for rank, p in enumerate(pairs.tolist())}

    @classmethod
    def of(cls, library: Tokenizer) -> _Merges | None:
        """The merges of a vocabulary, or None where it merges in another way than this."""
        model = json.loads(library.to_str())["model"]
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain:
            return None
        try:
            return cls(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        except (KeyError, ValueError):
            return None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.rank[at], len(self.made))

    def ids(self, coded: list[bytes]) -> list[bytes]:
        none, lengths = len(self.made), np.array([len(x) for x in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(lengths)
        symbols, word = self.inner[data], np.repeat(np.arange(len(coded)), lengths)
        symbols[ends - 1] = self.final[data[ends - 1]]
        rank = np.full(len(symbols), none)  # of the pair that starts here
        rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(symbols[:-1], symbols[1:]), none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            if (over := least == none).any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, least = (x[~over] for x in (symbols, word, rank, least))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            # of pairs that overlap, as in a run of one letter, every second one is merged
            fresh = np.r_[True, at[1:] != at[:-1] + 1]
            if not fresh.all():
                first = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            at = at - np.arange(len(at))  # where they stand once their right halves are gone
            symbols, word, rank = symbols[left], word[left], rank[left]
            near = np.r_[at, at[at > 0] - 1]
            near = near[near + 1 < len(symbols)]
            rank[at] = none
            rank[near] = np.where(word[near] == word[near + 1], self._ranks(symbols[near], symbols[near + 1]), none)
        if not done:
            return []
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        data, ends = symbols[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(coded)))).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


def _cuts(text: str):
    """Cuts of about ``PIECE`` characters, each but the last before a space: no token crosses one."""
    lo = 0
    while lo < len(text):
        m = _SPACE.search(text, lo + PIECE)
        hi = m.start() if m else len(text)
        yield text[lo:hi]
        lo = hi


class _Remembered:
    """Results by string, in two generations: what was not asked for during a generation goes. ``fixed`` always stays."""

    def __init__(self, most: int, fixed: dict):
        self.most, self.fixed = most, fixed
        self.young, self.old = dict(fixed), {}

    def all_of(self, wanted: Collection, make) -> dict:
        """A table that has all ``wanted``, each named once; ``make`` gives the values of a list of new ones."""
        if len(self.young) + len(wanted) > len(self.fixed) + self.most // 2:
            self.young, self.old = dict(self.fixed), self.young
        young, old = self.young, self.old
        rest = [w for w in wanted if w not in young]
        if old:
            young.update({w: old[w] for w in rest if w in old})
            rest = [w for w in rest if w not in young]
        young.update(zip(rest, make(rest), strict=True))
        return young


def segmenter(path: str) -> Segmenter:
    """One per Python worker, as long as its tasks ask for it."""
    return resident(path, lambda: Segmenter(path))
