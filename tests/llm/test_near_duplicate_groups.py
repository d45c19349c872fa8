import random

import pytest

from pataspark.llm import minhash
from texts import WORDS


def _changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(5, len(words) - 5, 10), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


@pytest.fixture
def pair_counts(monkeypatch):
    """How many pairs each call of ``confirmed`` is given."""
    seen, plain = [], minhash.confirmed

    def counted(pairs, sets, percent=minhash.PERCENT):
        seen.append(pairs.count())
        return plain(pairs, sets, percent)
    monkeypatch.setattr(minhash, "confirmed", counted)
    return seen


def test_copies_of_a_common_origin_cost_no_square_whatever_their_ids(spark, pair_counts):
    """Copies are too unlike each other to be linked, but each is linked with the origin."""
    rng = random.Random(2)
    origin = [rng.choice(WORDS) for _ in range(200)]
    texts = [" ".join(_changed(rng, origin, 3)) for _ in range(150)] + [" ".join(origin)]
    given = []
    for seed in range(3):
        ids = list(range(len(texts)))
        random.Random(seed).shuffle(ids)
        before = len(pair_counts)
        found = minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
        assert {r["component_id"] for r in found} == {0} and len(found) == 151
        given.append(sum(pair_counts[before:]))
    assert max(given) <= 2 * min(given) and max(given) < 10 * len(texts)


def test_groups_that_share_copies_equal_brute_force(spark):
    """Two origins with copies in between, and chains: several hub rounds and open pairs are needed."""
    rng = random.Random(6)
    texts = []
    for _ in range(4):
        at = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(25):
            texts.append(" ".join(at))
            texts += [" ".join(_changed(rng, at, rng.randrange(1, 5))) for _ in range(2)]
            at = _changed(rng, at, 2)
    rng.shuffle(texts)
    sets = [frozenset(minhash.shingle_set(t, minhash.WordHashes()).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: top(i) for i in range(len(texts))}


def test_repeated_rows_are_compared_once(spark, pair_counts):
    rng = random.Random(9)
    one = [rng.choice(WORDS) for _ in range(100)]
    two = _changed(rng, one, 1)
    rows = spark.createDataFrame([(5, " ".join(one)), (7, " ".join(two))], "doc_id long, text string")
    many = rows.crossJoin(spark.range(5_000).select())
    got = minhash.near_duplicates(many).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(5, 5, 5_000), (7, 5, 5_000)}
    assert sum(pair_counts) <= 2
