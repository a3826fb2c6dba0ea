import hashlib
import random

import numpy as np
import pytest

from airgrid.llm import recompression as R
from airgrid.llm import substring as S
from airgrid.llm.registry import QUERIES
from tests.llm.cases import EDGES, FOLDER, edges, exact, rows_of, words


def brute(docs, size=13):
    first = {}
    for k, t in docs:
        w = words(t)
        for i in range(len(w) - size + 1):
            g = tuple(w[i:i + size])
            if k is not None:
                first[g] = min(first.get(g, k), k)
    for k, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if k is not None and first[tuple(w[i:i + size])] < k:
                gone.update(range(i, i + size))
        yield k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def digests(rows):
    return exact((k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in rows)


def test_query_against_brute_force(spark):
    docs = rows_of("documents", "doc_id, text")
    assert exact(QUERIES["op5_substring_dedup"](spark, FOLDER).collect()) == digests(brute(docs))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    got = S.remove_repeats(edges(spark, extra)).collect()
    assert exact(got) == exact(brute([(k, t) for k, t, _, _ in EDGES]))


@pytest.mark.parametrize("size,letters", [(13, 1), (13, 2), (5, 2), (3, 3), (13, 30)])
def test_random_repeats(spark, size, letters):
    rng = random.Random(size * 100 + letters)
    made = []
    for k in range(60):
        w = [rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:letters]) for _ in range(rng.randint(0, 60))]
        if made and rng.random() < 0.6:
            source = words(rng.choice(made)[1])
            a = rng.randint(0, len(source))
            w[rng.randint(0, len(w)):0] = source[a:a + rng.randint(0, 40)]
        made.append((rng.randint(0, 50), " ".join(w) if not made or rng.random() < 0.8 else rng.choice(made)[1]))
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    assert exact(S.remove_repeats(df, size=size).collect()) == exact(brute(made, size))


def test_documents_in_parts_have_the_same_windows(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 3, n, dtype=np.uint64) for n in (0, 5, 13, 400, 0, 90, 37)]
    whole = [np.concatenate(x) for x in zip(*S._anchored(docs, 13, 3))]
    monkeypatch.setattr(S, "PART_WORDS", 20)
    parts = [np.concatenate(x) for x in zip(*S._anchored(docs, 13, 3))]
    order = np.lexsort((parts[1], parts[0]))
    assert all((a == b[order]).all() for a, b in zip(whole, parts))


@pytest.mark.parametrize("rounds", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("letters", [1, 2, 4, 50])
def test_equal_windows_have_equal_anchors(rounds, letters):
    rng = np.random.default_rng(rounds * 10 + letters)
    docs = [rng.integers(0, letters, n, dtype=np.uint64) for n in (200, 50, 13, 12, 1, 300)]
    docs.append(np.concatenate([docs[0][20:90], docs[5][100:180], docs[0][20:90]]))
    owner, at, key, own = (np.concatenate(x) for x in zip(*S._anchored(docs, 13, rounds)))
    assert len(at) == sum(max(0, len(d) - 12) for d in docs)
    by_words = {}
    for d, a, k, o in zip(owner, at, key, own):
        by_words.setdefault(docs[d][a:a + 13].tobytes(), set()).add((int(k), int(o)))
    assert all(len(v) == 1 for v in by_words.values())
    assert len({next(iter(v)) for v in by_words.values()}) == len(by_words)


def test_symbols_shrink_with_rounds():
    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    level = R.runs(R.Words(h, np.array([0, 5000])))
    for r in range(1, 4):
        after = R.pairs(level, r)
        assert len(after.name) < 0.85 * len(level.name)
        level = after


def test_texts_without_repeats(spark):
    docs = edges(spark, True)
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    expected = exact((k, t if not m else kept) for (k, t, _, _), (_, _, m, kept) in zip(EDGES, brute([(k, t) for k, t, _, _ in EDGES])))
    assert exact(out.select("doc_id", "text").collect()) == expected
    assert S.without_repeats(docs.limit(0)).count() == 0


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_texts_that_polynomials_take_for_copies(spark):
    """Polynomials modulo 2**64 agree on a pattern in Thue-Morse order and its complement, whatever their odd base."""
    one = [f"a{i}" for i in range(5)] + thue_morse(1024, "x", "y") + [f"b{i}" for i in range(5)]
    two = [f"a{i}" for i in range(5)] + thue_morse(1024, "y", "x") + [f"b{i}" for i in range(5)]
    three = [f"c{i}" for i in range(5)] + thue_morse(1024, "x", "y") + [f"d{i}" for i in range(5)]
    docs = [(k, " ".join(w)) for k, w in enumerate((one, two, three, one, two + ["end"]))]
    assert S._whole([w.encode() for w in one]) != S._whole([w.encode() for w in two])
    assert exact(S.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()) == exact(brute(docs))


def test_window_hash_and_anchor_are_independent():
    h = np.random.default_rng(3).integers(0, 2**63, 13, dtype=np.uint64)
    _, _, key, own = next(S._anchored([np.repeat(h[:1], 13)], 13, 3))
    assert key[0] != own[0]
