import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tenmark.llm import registry
from tenmark.llm.packing import best_fit_packing, plan
from tenmark.llm.token_counts import token_counts
from tenmark.llm.wordbpe import _ODD, _PRE, Segmenter, pre_tokens

from . import brute

PATH = registry.vocabulary()
#: Texts at which a shortcut could differ from the library.
ODD = ["<|endoftext|>a <|startoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|> <|endoftext|", "İstanbul ΣΑΣ é é x́ '́s", "don't 'S WE'LL it's''''s's", "１２ ½ x² ﬁ ǅ Ÿ × ÷ ŉ ſ", "\x1c a\x1cb \x85 c d e\x0bf\x0cg", "日本語 한국어 👩‍👩‍👧", "e\x00f", "", " \n\t", "x" * 5000]


@pytest.fixture(scope="module")
def own():
    return Segmenter(PATH)


def library_ids(own, t):
    ids = own.library.encode(t, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def test_ids_equal_the_library(spark, sf_dir, own):
    texts = ODD + [t or "" for _, t in brute.documents(registry.table(spark, sf_dir, "documents"))]
    assert own.ids(texts) == [library_ids(own, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZé'st ll\n<|>endoftx9½Σİ́"), st.characters(codec="utf-8"))), max_size=5))
def test_ids_equal_the_library_on_any_text(texts):
    own = test_ids_equal_the_library_on_any_text.own
    assert own.ids(texts) == [library_ids(own, t) for t in texts]


test_ids_equal_the_library_on_any_text.own = Segmenter(PATH)


def test_pre_tokens_are_those_of_the_pattern(spark, sf_dir):
    rng = random.Random(9)
    texts = [(t or "").lower() for _, t in brute.documents(registry.table(spark, sf_dir, "documents"))]
    texts += ["".join(rng.choices("'stmdrevlla é×÷ß12,.\n–“€ſ", k=rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["", "'", "''", "'s", "'l", "l'l", "'ll", "a'", "1'd2", "'re've", "'rx", "×", "é"]
    for t in texts:
        data = t.encode()
        got = [data[i:j].decode() for i, j in zip(*(x.tolist() for x in pre_tokens(data)), strict=True)]
        if not _ODD.search(t):
            assert got == _PRE.findall(t)


def test_merging_many_equals_the_library(own):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéinorstßž", k=rng.randrange(1, 25))) for _ in range(5000)] + ["a" * n for n in range(1, 40)] + ["-" * n for n in range(1, 40)] + ["ſ" * 7, "€…"]
    assert own.merges is not None
    assert own.merges.ids([w.encode() for w in words]) == own._alone(words)
    assert own.merges.ids([]) == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("tenmark.llm.wordbpe.REMEMBERED", 3)
    monkeypatch.setattr("tenmark.llm.wordbpe.PIECE", 8)
    own = Segmenter(PATH)
    texts = ["some words here", "other words there and é Σ", "some words again <|endoftext|>"]
    for t in texts * 3:
        assert own.ids([t]) == [library_ids(own, t)]


def test_counts_of_awkward_rows(spark, own):
    docs = brute.awkward(spark)
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=str)
    want = []
    for d, t in brute.documents(docs):
        n = len(library_ids(own, t or "")) // 4
        want.append((d, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 300) for n in rng.sample(range(1, 65), rng.randrange(1, 40))}
    taken, room = Counter(), defaultdict(list)
    for s in plan(counts, 64):
        assert s.first == taken[s.length]
        taken[s.length] += s.many
        for k in range(s.many):
            room[s.sequence + k].append((s.offset, s.length))
    assert taken == Counter(counts)
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(room) <= 1.02 * decreasing_best_fit(counts, 64) + 1


def decreasing_best_fit(counts, capacity):
    """Bins that the usual heuristic opens, as a mark to hold the plan against."""
    bins, gaps = 0, Counter()
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            gap = min((g for g in gaps if gaps[g] and g >= n), default=None)
            if gap is None:
                bins, gap = bins + 1, capacity
            else:
                gaps[gap] -= 1
            gaps[gap - n] += 1
    return bins


def check_packing(df, docs, own, capacity=4096):
    got, room = defaultdict(Counter), defaultdict(list)
    for r in df.collect():
        got[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        room[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for d, t in docs:
        ids = library_ids(own, t or "") + b"\1\0\0\0"
        for k in range(0, len(ids), 4 * capacity):
            part = ids[k : k + 4 * capacity]
            want[d][(k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert got == want
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n for parts in room.values() for _, n in parts)
    assert len(room) <= 1.02 * total / capacity + 2


def test_packing(spark, sf_dir, own):
    docs = registry.table(spark, sf_dir, "documents")
    check_packing(registry.QUERIES["op9_best_fit_packing"](spark, sf_dir), brute.documents(docs), own)


def test_packing_of_awkward_rows(spark, own):
    docs = brute.awkward(spark)
    check_packing(best_fit_packing(docs, PATH), brute.documents(docs), own)
    assert best_fit_packing(docs.limit(0), PATH).count() == 0
