import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airgrid.llm import components as C
from airgrid.llm import simhash as S
from airgrid.llm.registry import QUERIES
from tests.llm.cases import EDGES, FOLDER, edges, exact, rows_of, words


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def roots(fps, radius=3, group=None):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if (group is None or group[i] == group[j]) and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def expected(docs):
    fps = [fingerprint(t) for _, t in docs]
    root = roots(fps)
    least = {}
    for (k, _), r in zip(docs, root):
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return exact((k, f"{fp:016x}", least[r]) for (k, _), fp, r in zip(docs, fps, root))


def test_query_against_brute_force(spark):
    assert exact(QUERIES["op3_simhash_near_duplicates"](spark, FOLDER).collect()) == expected(rows_of("documents", "doc_id, text"))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    assert exact(S.near_duplicates(edges(spark, extra)).collect()) == expected([(k, t) for k, t, _, _ in EDGES])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 6])
def test_bit_planes_against_popcount(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 300):
        group = np.sort(rng.integers(0, 4, n))
        fp = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, n)]
        for _ in range(4):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(begin, n))
        size = np.repeat(sizes, sizes)
        left = np.repeat(begin + sizes, sizes) - np.arange(n) - 1
        assert S.link(fp, size, left, radius).tolist() == roots(fp, radius, group)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_a_hot_bucket_in_blocks_links_the_same(spark, block):
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(99) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = C.components(S.linked(df, block=block)).collect()
    name = {r.node: r.root for r in found}
    signed, root = fps.view(np.int64).tolist(), roots(fps)
    same = {}
    for x, r in zip(signed, root):
        same.setdefault(r, set()).add(name.get(x, x))
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def test_components_of_a_chain_a_star_and_loops(spark):
    edges_ = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (205, 200), (200, 205)]
    found = {r.node: r.root for r in C.components(spark.createDataFrame(edges_, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 205: 200}
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each(spark):
    docs = edges(spark, True)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", "text").collect()
    fps = [fingerprint(t) for _, t, _, _ in EDGES]
    root = roots(fps)
    assert len(got) == len(set(root)) and len({fingerprint(r.text) for r in got}) == len(got)
    least = {}
    for (k, *_), r in zip(EDGES, root):
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, least.values()))
    assert S.one_of_each(docs.limit(0)).count() == 0
    assert S.one_of_each(docs.withColumn("text", F.lit(None).cast("string"))).count() == 1


def test_folders_are_released_on_request(spark):
    from pathlib import Path

    from airgrid.llm import common

    common.release(spark)
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g")], "doc_id bigint, text string")
    assert S.near_duplicates(df).count() == 3
    left = list(common._left)
    assert left and all(Path(f).exists() for f in left)
    common.release(spark)
    assert not common._left and not any(Path(f).exists() for f in left)


def test_rows_that_share_half_a_name_are_told_by_the_whole(spark):
    from airgrid.llm.common import without_rows

    name = "struct(cast(a as bigint) as a, cast(b as bigint) as b) as row"
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (3, 3, "z"), (4, 4, "w")], "a int, b int, t string")
    gone, kept = rows.where("t in ('x', 'z')").selectExpr(name), rows.where("t in ('y', 'w')").selectExpr(name)
    assert sorted(r.t for r in without_rows(rows.selectExpr(name, "t"), gone, kept).collect()) == ["w", "y"]
    assert without_rows(rows.selectExpr(name, "t"), gone.limit(0), kept).count() == 4
