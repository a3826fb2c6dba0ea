import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.llm import neighbours as N
from airgrid.llm.registry import QUERIES
from tests.llm.cases import FOLDER, rows_of

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, asks, k, kind=np.float32):
    best = {(i, tuple(kind(x) for x in v)) for i, v in rows if i is not None and usable(v)}
    out = {}
    for q, a in best:
        if asks(q):
            scores = [(-float((np.array(a, dtype=float) * np.array(b, dtype=float)).sum()), i) for i, b in best if (i, b) != (q, a) and len(b) == len(a)]
            if scores:
                out[q] = sorted(out.get(q, []) + [(r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)])
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_query_against_brute_force(spark):
    assert found(QUERIES["op7_nearest_neighbours"](spark, FOLDER)) == brute(rows_of("embeddings", "vec_id, embedding"), lambda i: i % 20 == 0, 20)


@pytest.mark.parametrize("query_block,candidate_block", [(4096, 4096), (3, 7)])
def test_ties_gaps_and_repeats(spark, query_block, candidate_block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    rows += [(i, [1.0, 1.0, 0.0, -1.0]) for i in range(200, 260)] + [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 2.0]), (304, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(305, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (20, [9.0, 9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0, 9.0]), (7, [8.0] * 4), (7, [-8.0] * 4), (40, [0.5] * 4), (306, [1.0, 2.0]), (320, [2.0, 1.0]), (340, [1e30] * 4), (341, [1e-30] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("id", F.lit("clash")).withColumn("q", F.lit("clash"))
    got = found(N.nearest(df, F.col("vec_id") % 20 == 0, 5, query_block=query_block, candidate_block=candidate_block))
    assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_fewer_candidates_than_asked_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0)], SCHEMA)
    assert found(N.nearest(few, F.col("vec_id") == 0)) == {0: [(1, 1, 0.5)]}
    assert N.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert N.nearest(few, F.lit(None).cast("boolean")).count() == 0
    assert N.nearest(few.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_doubles_stay_doubles(spark):
    rows = [(k, [1 / (k + 3), 1 / (7 + k % 5), k / 3]) for k in range(60)] + [(20, [1 / 7, 0.0, 0.0]), (3, [1 / 9, 5.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA.replace("float", "double"))
    assert found(N.nearest(df, F.col("vec_id") % 20 == 0, 5)) == brute(rows, lambda i: i % 20 == 0, 5, float)


@pytest.mark.parametrize("dim", [16, 1_040, 1_041, 5_000])
def test_bounds_hold(dim):
    rng = np.random.default_rng(1)
    a, b = N.Quantised(rng.normal(size=(50, dim)) * 10 ** rng.uniform(-3, 3, (50, 1))), N.Quantised(np.abs(rng.normal(size=(60, dim))))
    about, off = N.tile(a, b)
    assert (np.abs(about - a.vectors @ b.vectors.T) <= off).all()
    assert np.abs(a.codes).max() <= 127
