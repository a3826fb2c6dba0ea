import hashlib
import math

import numpy as np
import pytest

from airgrid.llm import vector_codes as V
from airgrid.llm.registry import QUERIES
from tests.llm.cases import FOLDER, exact, rows_of


def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label); plain k-means with Python's whole numbers."""
    kept = [(k, [math.floor(1024 * x) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(order[0][1])
    alike = [r for r in order if len(r[1]) == dim]
    cuts = np.cumsum([0] + [len(p) for p in np.array_split(np.arange(dim), 4)]).tolist()
    books, codes, errors = [], [[] for _ in alike], [0] * len(alike)
    for a, b in zip(cuts, cuts[1:]):
        x = [r[1][a:b] for r in alike]
        book = [list(p) for p in x[:entries]]
        for turn in range(rounds + 1):
            far = [[sum((p - q) ** 2 for p, q in zip(v, e)) for e in book] for v in x]
            at = [d.index(min(d)) for d in far]
            if turn < rounds:
                for e in range(len(book)):
                    mine = [v for v, i in zip(x, at) if i == e]
                    if mine:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        books.append(book)
        for k, (i, d) in enumerate(zip(at, far)):
            codes[k].append(f"{i:02x}")
            errors[k] += d[i]
    total = {}
    for (_, _, g), e in zip(alike, errors):
        total[g] = total.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(k, "".join(c), e, total[g], digest) for (k, _, g), c, e in zip(alike, codes, errors)]
    return out + [(k, None, None, total.get(g), digest) for k, v, g in kept if len(v) != dim]


def found(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    return [tuple(r) for r in V.codes(df, **how).collect()]


def vectors(n, dim, seed=1, low=-1.0, high=1.0):
    values = np.random.default_rng(seed).uniform(low, high, (n, dim)).astype(np.float32)
    return [[float(x) for x in v] for v in values]


@pytest.mark.parametrize("n, dim, entries", [(1, 4, 256), (40, 8, 256), (300, 8, 8), (500, 12, 70), (400, 16, 33)])
def test_as_plain_rounds(spark, n, dim, entries):
    rows = [((k * 7) % 1009, v, k % 3 if k % 5 else None) for k, v in enumerate(vectors(n, dim))]
    assert exact(found(spark, rows, entries=entries)) == exact(brute(rows, entries))


def test_ties_and_copies(spark):
    # a coarse grid: many parts are equal or as far from two entries
    values = np.random.default_rng(4).integers(-2, 3, (600, 8))
    rows = [(k // 2, [float(x) / 1024 for x in v], 1) for k, v in enumerate(values)] + [(5, [0.0] * 8, None)] * 200
    assert exact(found(spark, rows, entries=40)) == exact(brute(rows, 40))


def test_edges(spark):
    good = vectors(30, 8, 9)
    rows = [(k, v, 1) for k, v in enumerate(good)] + [(100, None, 1), (101, [None] + good[0][1:], 1), (102, [math.nan] * 8, 2), (103, [math.inf] * 8, 2),
                                                      (104, [-math.inf] + good[0][1:], None), (None, good[3], None), (105, [0.0] * 8, 3), (106, good[0][:5], 1), (107, [], 4)]
    assert exact(found(spark, rows)) == exact(brute(rows))


def test_lengths_that_parts_do_not_divide(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(60, 7, 3))]
    assert exact(found(spark, rows, entries=9)) == exact(brute(rows, 9))
    rows = [(k, v, 0) for k, v in enumerate(vectors(20, 2, 3))]
    assert exact(found(spark, rows, entries=5)) == exact(brute(rows, 5))


def test_large_components_in_double(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(80, 8, 3, -16_383.0, 16_383.0))]
    assert exact(found(spark, rows, "double", entries=12)) == exact(brute(rows, 12))


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="or more in size"):
        found(spark, [(1, [20_000.0] * 4, 0)])


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_extra_columns(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(40, 8))]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id bigint, embedding array<float>, label int, code string, v string, id string")
    assert exact(V.codes(df).collect()) == exact(brute(rows))


def test_bounds_rule_out_most_scans():
    """Net displacements let later rounds scan far fewer entries than all of them; results stay those of full scans."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (64, 16))
    x = np.concatenate([c + rng.integers(-60, 60, (40, 16)) for c in centres]).astype(np.int64)
    history, state, scanned = [np.repeat(centres, 2, axis=0) + rng.integers(-300, 300, (128, 16))], None, []
    real = V.squared
    for _ in range(5):
        book = V.Codebook(history)
        if state is None:
            state = book.start(x)
        else:
            seen = []
            V.squared = lambda a, b, seen=seen: (seen.append(len(a) * len(b)), real(a, b))[1]
            try:
                state = book.again(x, state[0], state[2], state[3])
            finally:
                V.squared = real
            scanned.append(sum(seen) / (len(x) * len(book.now)))
        plain = real(x, book.now)
        assert (state[0] == plain.argmin(1)).all() and (state[1] == plain.min(1)).all()
        new = history[-1].copy()
        for e in np.unique(state[0]):
            new[e] = x[state[0] == e].sum(0) // (state[0] == e).sum()
        history.append(new)
    assert scanned[-1] < 0.6


def test_net_displacement_is_tighter_than_the_way():
    there, back = np.zeros((4, 3), dtype=np.int64), np.full((4, 3), 50, dtype=np.int64)
    book = V.Codebook([there, back, there])
    assert book.moved[0].max() == 0 and book.moved[1].max() > 80


def test_query(spark):
    rows = rows_of("embeddings", "vec_id, embedding, label")
    assert exact(QUERIES["op12_vector_codes"](spark, FOLDER).collect()) == exact(brute(rows))
