import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.llm import merkle as M
from airgrid.llm import sha256
from airgrid.llm.registry import QUERIES
from tests.llm.cases import EDGES, FOLDER, edges, exact, rows_of


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def up(nodes):
    """Root of some nodes, and each node's runs on the way: (siblings and itself, its place)."""
    ways = [[] for _ in nodes]
    at, row = list(range(len(nodes))), list(nodes)
    while len(row) > 1:
        runs = [row[i:i + 16] for i in range(0, len(row), 16)]
        for k, i in enumerate(at):
            ways[k].append((runs[i // 16], i % 16))
        at, row = [i // 16 for i in at], [H("".join(r)) for r in runs]
    return row[0], ways


def brute(docs):
    """docs: (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for d in docs:
        by_source.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, leaf(d), d))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda x: x[:3]) for s in order}
    tops = {s: up([x[2] for x in trees[s]]) for s in order}
    root, above = up([tops[s][0] for s in order]) if order else ("", [])
    out = []
    for s, over in zip(order, above):
        for (_, _, own, d), way in zip(trees[s], tops[s][1]):
            way = way + over
            proof = H("".join(x for run, i in way for j, x in enumerate(run) if j != i))
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            folded = leaf((*d[:4], lower(d[4]))) if tampered else own
            for run, i in way:
                folded = H("".join([*run[:i], folded, *run[i + 1:]]))
            out.append((d[0], own, tops[s][0], root, proof, folded, folded == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(docs):
    return M.manifest(M.leaves_of(docs, tampered=M.tampered_fifth(F.col("doc_id")))).withColumnRenamed("key", "doc_id").select(NAMES)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


@pytest.mark.parametrize("length", [0, 1, 55, 63, 64, 65, 128, 640])
def test_states_resume_like_the_library(length):
    data = bytes(i * 37 % 256 for i in range(32 * length))
    digests = np.frombuffer(data, dtype=np.uint8).reshape(-1, 32)
    state = sha256.fresh(1)
    for block in sha256.hex_block(digests).T:
        state = sha256.bytes_state(sha256.state_bytes(sha256.compress(state, block[:, None])))
    assert sha256.finish(state, np.array([length])).tobytes().hex() == H(data.hex())


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = edges(spark, extra).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = [(k, s, g, None if t is None else len(t), t) for k, t, g, s in EDGES]
    assert exact(found(docs).collect()) == exact(brute(rows))


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [257, 1, 16], [4200, 3], [2] * 40])
def test_shapes(spark, sizes):
    rows = [(k * 7919 % 100_003, f"s{s}", "en", k, f"Text {k} OF {s}") for s, n in enumerate(sizes) for k in range(n)]
    assert exact(found(made(spark, rows)).collect()) == exact(brute(rows))


def test_repeated_rows_and_ids(spark):
    rows = [(None, None, None, None, None)] * 300 + [(5, "a", None, 1, "X")] * 40 + [(5, "a", None, 1, f"Y{k}") for k in range(40)] + [(5, None, "", 1, "é" * 9)]
    assert exact(found(made(spark, rows).repartition(7)).collect()) == exact(brute(rows))


def test_no_rows(spark):
    out = found(made(spark, []))
    assert out.count() == 0 and out.columns == NAMES


def test_files_are_deleted_on_request(spark, tmp_path):
    from pathlib import Path

    out = M.manifest(M.leaves_of(made(spark, [(1, "a", "b", 1, "c"), (2, "a", "b", 1, "c")])))
    assert out.count() == 2 and all(Path(f).exists() for f in out._folders)
    M.forget(out)
    assert not any(Path(f).exists() for f in out._folders)


def test_query(spark):
    rows = rows_of("documents", "doc_id, source, lang, n_chars, text")
    got = QUERIES["op11_merkle_manifest"](spark, FOLDER).select(NAMES).collect()
    assert exact(got) == exact(brute(rows))
    assert 0 < sum(not r.verified for r in got) < len(got) / 4


def test_a_step_holds_few_rows(spark):
    from airgrid.llm.common import arrow_map

    seen = arrow_map(spark.range(0, 5000, 1, 2), "id bigint, rows bigint", lambda c: {"id": c["id"], "rows": [len(c["id"])] * len(c["id"])}, step_rows=M.PARENTS)
    assert seen.count() == 5000 and seen.agg(F.max("rows"), F.sum("id")).first()[:] == (M.PARENTS, 5000 * 4999 // 2)
