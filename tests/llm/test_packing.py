import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airgrid.llm import packing as P
from airgrid.llm.common import vocabulary
from airgrid.llm.registry import QUERIES
from tests.llm.cases import EDGES, FOLDER, edges, exact, rows_of


def pieces(docs, capacity):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for k, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for i in range(0, len(ids), capacity):
            part = ids[i:i + capacity]
            yield k, i // capacity, i, len(part), zlib.crc32(part.tobytes())


def check(rows, docs, capacity):
    assert exact((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == exact(pieces(docs, capacity))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_query(spark):
    n, bound = check(QUERIES["op4_pattern_packing"](spark, FOLDER).collect(), rows_of("documents", "doc_id, text"), 2048)
    assert n <= bound + 1


@pytest.mark.parametrize("extra,capacity", [(False, 2048), (True, 7), (False, 1)])
def test_edges(spark, extra, capacity):
    rows = P.pack(P.cut(edges(spark, extra), vocabulary("word_bpe_49k.json"), capacity, with_ids=True), capacity).collect()
    check(rows, [(k, t) for k, t, _, _ in EDGES], capacity)
    assert all(len(r.ids) == r.length for r in rows)


def test_no_rows(spark):
    assert P.pack(P.cut(edges(spark).limit(0), vocabulary("word_bpe_49k.json"), 64), 64).count() == 0


def test_lengths_out_of_range_are_an_error(spark):
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 0, 9)], "doc_id bigint, piece int, length bigint"), 8)


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_each_document_once_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 300))
    lengths = np.clip(rng.lognormal(rng.uniform(0, 5), 1.0, 3000).astype(int) + 1, 1, capacity)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    used = np.zeros_like(histogram)
    sequences = P.plan(histogram)
    for content, repeat in sequences:
        assert sum(content) <= capacity and repeat > 0
        for n in content:
            used[n] += repeat
    assert (used == histogram).all()
    decreasing = sum(r for _, r in P.best_fit(histogram.copy(), capacity))
    assert sum(r for _, r in sequences) <= max(1.02 * decreasing, decreasing + 2)


def test_the_fit_finds_exact_patterns():
    """As many full sequences as there can be: 600.

    Let 40 cost 1, 50 and 20 a half, 60 and 30 nothing. Each content of exactly 100 costs at least 1 (checked below), all
    documents together cost 500 + 50 + 50 = 600.
    """
    cost = {60: 0, 40: 2, 30: 0, 50: 1, 20: 1}
    full = [c for n in range(1, 6) for c in itertools.combinations_with_replacement(cost, n) if sum(c) == 100]
    assert full and min(sum(cost[x] for x in c) for c in full) == 2
    histogram = np.bincount([60] * 500 + [40] * 500 + [30] * 300 + [50] * 100 + [20] * 100, minlength=101)
    sequences = P.plan(histogram)
    assert sum(r for c, r in sequences if sum(c) == 100) == 600
    assert sum(r for _, r in sequences) <= 668


def fewest(lengths, capacity):
    """Fewest sequences, by trying every place for the longest document that is left."""
    best = len(lengths)

    def place(rest, filled):
        nonlocal best
        if len(filled) >= best:
            return
        if not rest:
            best = len(filled)
            return
        for k in sorted({f: i for i, f in enumerate(filled)}.values()):
            if filled[k] + rest[0] <= capacity:
                place(rest[1:], [*filled[:k], filled[k] + rest[0], *filled[k + 1:]])
        place(rest[1:], [*filled, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def test_few_documents_need_one_sequence_more_at_most():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = rng.integers(1, 40, rng.integers(1, 11)).tolist()
        found = sum(r for _, r in P.plan(np.bincount(lengths, minlength=41)))
        assert fewest(lengths, 40) <= found <= fewest(lengths, 40) + 1


def test_a_hot_length_is_numbered_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 10)
    rows = spark.range(2000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 5, 1 + id % 8) as bigint) as length", "'x' as sequence_id")
    found = P.pack(rows, 8).collect()
    places = {(r.sequence_id, r.offset) for r in found}
    assert len(found) == len(places) == 2000
    assert max(r.offset + r.length for r in found) <= 8


def test_columns_of_any_name_and_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    clash = ("_row", "_bucket", "_rank", "_length", "_in", "_n", "held", "spread", "bucket", "rank", "nth", "base", "n", "a b", "sequence_id", "offset")
    rows = spark.range(0, 1200, 1, 6).selectExpr("cast(null as bigint) as doc_id", "0 as piece", "cast(1 + id % 3 * 2 as bigint) as length", "id as own")
    for name in clash:
        rows = rows.withColumn(name, F.lit("clash"))
    out = P.pack(rows, 8)
    assert sorted(out.columns) == sorted({"doc_id", "piece", "length", "own", *clash})
    found = out.collect()
    assert sorted(r.own for r in found) == list(range(1200)) and all(r["_rank"] == r.held == r["a b"] == "clash" for r in found)
    filled = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 8
