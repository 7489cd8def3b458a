import random
import string

import pytest

from tenmark.llm import secrets


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in secrets.secret_scan(df).collect()}


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"])
def test_random_strings_are_found(spark, alphabet):
    rng = random.Random(11)
    for n, share in ((20, 0.95), (24, 0.98), (32, 0.99)):
        keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(400)]
        keys = [k for k in keys if any(c.isdigit() for c in k) and any(c.isalpha() for c in k)]
        found = spans(spark, [f"a {k} b" for k in keys])
        assert sum(s == f"entropy:2:{2 + n}" for s in found.values()) >= share * len(keys)


def test_only_the_matching_part_is_left_out(spark):
    key = "gJ7xQ2vT9bLk4RzWm1Yc8PdHs5Nf"
    n = len(key)
    found = spans(spark, [f"sample/{key}", f"{key}AAAAAAAA{key}", f"AKIA{'1B' * 8}/{key}", "sample/" + key[:12]])
    assert found[0] == f"entropy:6:{7 + n}"  # the slash belongs to the alphabet
    assert found[1] == f"entropy:0:{n},entropy:{n + 8}:{2 * n + 8}"
    assert found[2] == f"access:0:20,entropy:20:{21 + n}"
    assert found[3] == ""
