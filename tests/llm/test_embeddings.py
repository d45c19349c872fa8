import itertools
import random
import re
import struct

import numpy as np
import pytest

from pataspark.llm import embedding_links, filter_audit, whitening

EMBEDDING = "vec_id long, embedding array<float>, label int"


def _float32(values):
    return [struct.unpack("f", struct.pack("f", v))[0] for v in values]


@pytest.fixture(scope="module")
def near_vectors():
    """Random vectors, chains of close ones, balls of close copies, exact copies, and another scale of one vector."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16), int(rng.integers(0, 2))) for i in range(400)]
    base = rng.normal(size=16)
    rows += [(1000 + i, base + rng.normal(size=16) * 0.12, 0) for i in range(300)]
    point = rng.normal(size=16)
    for i in range(60):
        point = point + rng.normal(size=16) * 0.22
        rows.append((2000 + i, point, 1))
    rows += [(3000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(3100, rows[0][1] * 7, rows[0][2]), (3200, rows[1][1], None)]
    rng.shuffle(rows)
    return [(int(i), _float32(v), label) for i, v, label in rows]


def _links(rows):
    sound = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n, parent = {id(r): 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in itertools.combinations(sound, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= embedding_links.COSINE:
                n[id(a)] += 1
                n[id(b)] += 1
                i, j = top(a[0]), top(b[0])
                parent[max(i, j)] = min(i, j)
    return sorted((r[0], n[id(r)], top(r[0]), r[0] == top(r[0])) for r in rows)


@pytest.mark.parametrize("cell, block, deal", [(256, 4096, 50_000), (16, 4096, 100), (10_000, 50, 50_000), (32, 20, 64)])
def test_links_equal_brute_force_at_every_size_of_cells_and_blocks(spark, near_vectors, monkeypatch, cell, block, deal):
    monkeypatch.setattr(embedding_links, "CELL", cell)
    monkeypatch.setattr(embedding_links, "BLOCK", block)
    monkeypatch.setattr(embedding_links, "DEAL", deal)
    got = sorted(tuple(r) for r in embedding_links.linked_vectors(spark.createDataFrame(near_vectors, EMBEDDING)).collect())
    want = _links(near_vectors)
    assert got == want
    assert max(w[1] for w in want) > 100 and len({w[2] for w in want}) > 100


def test_links_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 5, "x"), (1, [1.0, 0.0], 5, "y"), (2, None, 5, "x"), (3, [], 5, "x"), (4, [0.0, 0.0], 5, "x"), (5, [1.0, None], 5, "x"), (6, [1.0, nan], 5, None),
        (7, [inf, 0.0], 5, None), (8, [1.0, 0.0], None, None), (9, [1.0, 0.0], 6, None), (None, [1.0, 0.0], 5, None), (10, [1.0, 0.1], 5, None), (11, [1.0, 0.0, 0.0], 5, None),
        (10, [0.0, 1.0], 5, None), (12, [0.0, 2.0], 5, None), (13, [3e38, 3e37], 5, None), (14, [-1.0, 0.0], 5, None)]
    docs = spark.createDataFrame(rows, EMBEDDING + ", node string").selectExpr("*", "node AS component", "node AS class", "node AS h1")
    got = sorted((tuple(r) for r in embedding_links.linked_vectors(docs).collect()), key=str)
    # Vector 10 has two rows, which tie the groups of 1, 13 and of 12 together.
    assert got == sorted([
        (1, 3, 1, True), (1, 3, 1, True), (10, 3, 1, False), (10, 1, 1, False), (11, 0, 11, True), (12, 1, 1, False), (13, 3, 1, False), (14, 0, 14, True),
        (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 0, None, True)], key=str)
    assert embedding_links.linked_vectors(docs.limit(0)).collect() == []


def _whiten(x, k):
    n = len(x)
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    order = np.argsort(-values)[:k]
    return (x - mean) @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("d, stretch", [(40, 1.0), (7, 1.0), (40, 2e6)])
def test_whitening_equals_an_eigenvalue_solver(spark, d, stretch):
    rng = np.random.default_rng(8)
    rows = [(i, _float32(rng.normal(size=d) * np.linspace(1, 3, d) * stretch), None) for i in range(300)]
    got = whitening.whitened(spark.createDataFrame(rows, EMBEDDING)).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    k = min(32, d)
    want, share = _whiten(x.astype(float), k)
    values = got["whitened"].to_numpy().reshape(300, k)
    signs = np.sign((values * want).sum(axis=0))
    assert np.abs(values - want * signs).max() < 1e-8
    assert np.abs(got["explained"].to_numpy().reshape(300, k)[0] / share - 1).max() < 1e-10
    assert (got["n"] == 300).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    exact = [sum((300 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    assert all((e if e < 2 ** 63 else None) == (None if np.isnan(g) else int(g)) if e >= 2 ** 53 else e == g for e, g in zip(exact, got["deviation"].to_numpy()[::k]))


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(i, [float(i), float(i * i), 1.0], 0) for i in range(6)] + [(5, [5.0, 25.0, 1.0], 0), (None, [2.0, 9.0, 1.0], None)]
    odd = [(10, None, 0), (11, [], 0), (12, [1.0, None, 1.0], 0), (13, [nan, 1.0, 1.0], 0), (14, [inf, 1.0, 1.0], 0), (15, [1.0], 0), (16, [3e38, 0.0, 0.0], 0)]
    frame = spark.createDataFrame(sound + odd, EMBEDDING).selectExpr("*", "label AS n", "label AS v", "label AS component")
    got = whitening.whitened(frame).collect()
    # The third dimension does not vary, so there are two components.
    assert len(got) == 16 and {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {8}
    assert abs(sum(r["explained"] for r in got) / 8 - 1) < 1e-12
    assert [r for r in whitening.whitened(frame.filter("vec_id = 3")).collect()] == []
    assert whitening.whitened(frame.limit(0)).collect() == []


def test_factors_give_the_matrix_back():
    rng = np.random.default_rng(1)
    for rank in (1, 5, 9):
        half = rng.normal(size=(9, rank))
        g = whitening.pivoted_cholesky(half @ half.T)
        assert g.shape == (9, rank) and np.allclose(g @ g.T, half @ half.T, rtol=0, atol=1e-12)
        rotated = whitening.one_sided_jacobi(g)
        assert np.allclose(rotated.T @ rotated, np.diag((rotated ** 2).sum(axis=0)), rtol=0, atol=1e-11)
        assert np.allclose(rotated @ rotated.T, half @ half.T, rtol=0, atol=1e-11)


def _audit(rows, labels):
    """Every step of every order, document by document."""
    split = [(r, [w for w in re.split("[ \t-\r]+", r[1] or "") if w]) for r in rows]
    fails = []
    for r, w in split:
        text = r[1] or ""
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
             "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows)}
        fails.append({k for k, v in f.items() if v})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        total = {x: 0 for x in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                here = [r for r, f in mine if x in f and not f & set(order[:step - 1])]
                total[x] += len(here)
                out[part, order, step] = (
                    sum(not f & set(order[:step]) for _, f in mine), len(here), sum(x in f and bool(f & set(order[:step - 1])) for _, f in mine),
                    sum(f == {x} for _, f in mine), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, total[order[step - 1]])
    return out


def test_filter_audit_equals_every_order_document_by_document(spark):
    rng = random.Random(4)
    texts = ["", None, "one two", " \n\t ", "A " * 300, "x " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(220)) + " #", "Ñandú " * 201,
             " ".join(f"W{i}" for i in range(300)), "漢字 " * 400 + "|", " ".join(f"u{i}" for i in range(30_000))]
    rows = [(rng.choice([None, *range(90)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(150)]
    rows += rows[:10]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(95), 60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang AS part", "lang AS fails", "lang AS rows", "lang AS good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "toxic AS part")
    got = filter_audit.audit_filters(docs, marks).collect()
    want = _audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want) == 600 * 3
    assert filter_audit.audit_filters(docs.limit(0), marks).collect() == []
    assert len(filter_audit.audit_filters(docs, marks.limit(0)).collect()) == 1800
