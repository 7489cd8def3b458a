from tenmark.llm.packing import _Lengths


def test_a_pair_is_found_behind_many_that_are_used_up():
    held = tuple(range(1, 10))
    counts = {x: 1 for a in held for x in (a, 100 - a)} | {20: 1, 80: 1}
    assert _Lengths(counts, 100).pair(100, held) == (80, 20)
    assert _Lengths(counts, 100).pair(100, ()) == (99, 1)
    assert _Lengths({50: 2}, 100).pair(100, ()) == (50, 50)
    assert _Lengths({50: 2}, 100).pair(100, (50,)) == () == _Lengths({50: 1}, 100).pair(100, ())
