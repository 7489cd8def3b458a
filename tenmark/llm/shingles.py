"""Word shingles of whole texts as sorted 64-bit hashes, and the T-occurrence search over them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import xxhash

#: Bytes that are hashed at once; longer texts go in cuts at white space.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_seeds = np.random.default_rng(20240601).integers(1, 1 << 63, 257, np.uint64) * np.uint64(2) + np.uint64(1)
#: A value for each byte, A-Z as a-z and white space 0, and the base of the polynomial (5 modulo 8, so that it has no small order).
_VALUES, _BASE = _seeds[:256].copy(), _seeds[256] // np.uint64(8) * np.uint64(8) + np.uint64(5)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[_SPACE] = 0
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PIECE + 2), _powers(_INVERSE, PIECE + 2)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of ``data`` starts and ends, and its hash."""
    a = np.frombuffer(data, np.uint8)
    space = np.empty(len(a) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[a]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, span_hashes(data, starts, ends)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span, A-Z as a-z: a polynomial over its bytes, modulo 2^64."""
    if len(data) > PIECE:  # one word longer than a piece
        return np.array([xxhash.xxh3_64_intdigest(data[i:j].lower()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[np.frombuffer(data, np.uint8)] * _UP[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts]


def _cuts(data: bytes):
    """Cuts of at most ``PIECE`` bytes that end before white space, or one word that is longer."""
    lo = 0
    while len(data) - lo > PIECE:
        room = data[lo : lo + PIECE]
        hi = lo + max(room.rfind(x) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if hi <= lo:
            ends = [k for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := data.find(x, lo + 1)) > 0]
            hi = min(ends, default=len(data))
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def _words(texts: list[str] | list[bytes]):
    """For runs of texts: how many words each has, and the hashes of all their words."""
    held, size = [], 0
    for t in texts:
        data = t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        if held and size + len(data) >= PIECE:
            yield _counted(held)
            held, size = [], 0
        if len(data) >= PIECE:
            h = np.concatenate([word_hashes(c)[2] for c in _cuts(data)])
            yield np.array([len(h)]), h
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield _counted(held)


def _counted(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts, _, h = word_hashes(b"\n".join(held))
    ends = np.cumsum([len(d) + 1 for d in held])
    return np.diff(np.searchsorted(starts, ends), prepend=0), h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words."""
    run = h[: max(0, len(h) - size + 1)]
    for k in range(1, size):
        run = _mix(run) + h[k : len(h) - size + 1 + k]
    return _mix(run)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x


def shingle_sets(texts: list[str] | list[bytes], size: int) -> list[np.ndarray]:
    """Distinct shingles of ``size`` words of each text, sorted; a shorter text is one shingle, none is empty.

    A-Z are lowered and words end at ASCII white space.
    """
    out = []
    for counts, h in _words(texts):
        run, at = _runs(h, size), 0
        for n in counts.tolist():
            if n >= size:
                out.append(_distinct(run[at : at + n - size + 1]))
            elif n:
                out.append(_mix(_runs(h[at : at + n], n) + np.uint64(n)))  # apart from shingles of ``size`` words
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def shingle_runs(texts: list[str] | list[bytes], size: int):
    """Arrays with the shingles of texts of ``size`` words or more, repeated ones too; shorter texts have none here."""
    for counts, h in _words(texts):
        run = _runs(h, size)
        ends = np.cumsum(counts)
        inside = np.ones(len(h) + 1, np.int32)
        for k in range(1, size):  # runs that would cross into the next text
            inside[np.maximum(ends - k, 0)] = 0
        yield run[inside[: len(run)] > 0]


def digest(shingles: np.ndarray) -> bytes:
    """A 128-bit name for a set of shingles."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set that it links with."""
    return -(-percent * n // 100)


def _merge(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that ``need`` of the sorted lists have, with their counts: a heap for few, runs for many."""
    if sum(map(len, lists)) <= 64:
        found, counts, last, n = [], [], -1, 0
        for x in [*heapq.merge(*(x.tolist() for x in lists)), -2]:
            if x == last:
                n += 1
                continue
            if n >= need and last >= 0:
                found.append(last)
                counts.append(n)
            last, n = x, 1
        return np.array(found, np.int64), np.array(counts, np.int64)
    members, counts = np.unique(np.concatenate(lists), return_counts=True)
    return members[counts >= need], counts[counts >= need]


def divide_skip(lists: list[np.ndarray], need: int, wanted, mu: float = 0.0085) -> tuple[np.ndarray, np.ndarray]:
    """T-occurrence search: members of at least ``need`` of the sorted ``lists``, with their counts.

    The longest lists are set apart. The short ones are merged and give every member that can still reach
    ``need``; ``wanted`` keeps those of interest; the long ones are then only probed by binary search, and a
    member is given up once the lists left cannot bring it to ``need``.
    """
    none = np.empty(0, np.int64)
    if len(lists) < need:
        return none, none
    lists = sorted(lists, key=len)
    apart = min(need - 1, int(need / (mu * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    members, counts = _merge(short, max(1, need - apart))
    keep = wanted(members)
    members, counts = members[keep], counts[keep]
    for k, own in enumerate(long):
        if not len(members):
            break
        at = np.searchsorted(own, members)
        counts = counts + (own[np.minimum(at, len(own) - 1)] == members)
        alive = counts + (len(long) - 1 - k) >= need
        members, counts = members[alive], counts[alive]
    return members, counts


def least_common(a, b, percent: int):
    """Shingles that linked sets of ``a`` and ``b`` shingles share at least."""
    return -(-percent * (a + b) // (100 + percent))


def spare(n, percent: int):
    """How much longer than needed a prefix is kept, so that candidates must share that many more."""
    return n * (100 - percent) // 400


def _search(sets: list[np.ndarray], sizes: np.ndarray, percent: int, need, open_to, side: np.ndarray | None = None):
    """``x, members, counts`` of the sets before each set that share ``need(x)`` with it.

    ``sizes``, ascending, are those of the whole sets. ``open_to(x, members)``: which members are of interest.
    ``side``: only pairs of unequal sides count.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    values = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")  # owners stay ascending within a value
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(values)] if len(values) else starts
    tokens = values[starts] if len(values) else values
    shared = ends - starts > 1
    for x in range(1, n):
        at = np.searchsorted(tokens, sets[x])
        at = at[shared[at]]
        least = max(1, need(x))
        if len(at) < least:
            continue
        lists = [owner[starts[k] : ends[k]] for k in at]

        def wanted(members, x=x):
            keep = (members < x) & open_to(x, members) & (100 * sizes[members] >= percent * sizes[x])
            return keep if side is None else keep & (side[members] != side[x])

        yield x, *divide_skip(lists, least, wanted)


def forest(sets: list[np.ndarray], sizes: np.ndarray, percent: int, need, accept, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect what all accepted pairs among ``sets`` connect.

    Members that a set is already connected with are not looked at. ``accept(x, y, n)`` decides for ``n`` shared.
    """
    group, links, groups = np.arange(len(sets)), [], len(sets)
    for x, members, counts in _search(sets, sizes, percent, need, lambda x, members: group[members] != group[x], side):
        for y, i in zip(members.tolist(), counts.tolist(), strict=True):
            if group[y] != group[x] and accept(x, y, i):
                links.append((x, y))
                group[group == group[y]] = group[x]
                groups -= 1
        if groups == 1:
            break
    return links


def counted_links(sets: list[np.ndarray], weights: np.ndarray, percent: int, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Every link among whole sets, shortest first: pairs that connect all of them, and for each set the ``weights`` it links with."""
    n, total = np.array([len(s) for s in sets], np.int64), np.zeros(len(sets), np.int64)
    group, pairs = np.arange(len(sets)), []
    for x, members, counts in _search(sets, n, percent, lambda x: least_overlap(int(n[x]), percent), lambda x, members: np.ones(len(members), bool), side):
        linked = members[100 * counts >= percent * (n[x] + n[members] - counts)]
        total[x] += weights[linked].sum()
        total[linked] += weights[x]
        while len(apart := linked[group[linked] != group[x]]):
            pairs.append((x, int(apart[0])))
            group[group == group[apart[0]]] = group[x]
    return pairs, total


def links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (100 * intersection >= percent * union) among whole sets that connect what all of them do, shortest first."""
    n = np.array([len(s) for s in sets], np.int64)
    return forest(sets, n, percent, lambda x: least_overlap(int(n[x]), percent), lambda x, y, i: 100 * i >= percent * (n[x] + n[y] - i), side)


def candidates(prefixes: list[np.ndarray], lost: np.ndarray, sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that may link, by their prefixes alone; shortest first.

    If two sets share T shingles, prefixes of ``n - T + l`` share ``l`` of them. Those here are longer than
    ``n - ceil(t * n) + 1`` by ``spare``. ``lost`` counts what each prefix lacks because values coincide.
    """
    n, extra, least = sizes.tolist(), spare(sizes, percent).tolist(), [least_overlap(int(k), percent) for k in sizes]

    def need(x):
        return 1 + min(extra[x], int(spare(least[x], percent))) - int(lost[x])

    def accept(x, y, i):
        t = least_common(n[x], n[y], percent)
        return i + min(lost[x], lost[y]) >= 1 + min(extra[x] + t - least[x], extra[y] + t - least[y])

    return forest(prefixes, sizes, percent, need, accept, side)
