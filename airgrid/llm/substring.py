"""Substring dedup: windows of words that an earlier document holds too, found through recompression symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, column_type, written
from airgrid.llm.recompression import BASE_2, INVERSE_2, ROUNDS, Words, anchors, mix

WINDOW = 13
#: Words that are parsed at once; a longer document is parsed in parts that overlap by a window less one word.
PART_WORDS = 100_000
#: Bytes of text that are asked about together.
STEP_BYTES = 3_000_000
NO_ID = -(1 << 63)
#: Kinds of rows that documents send to buckets of symbols.
ANCHOR, TOLD, WHOLE, TOLD_COPY, HELD, GONE = range(6)
ASKED = ("kind", "bucket", "keys", "other", "docs")
ASKED_SCHEMA = "kind int, bucket int, keys binary, other binary, docs binary"
#: Buckets have about so many anchors, texts one for about so many characters; results do not depend on either.
BUCKET_ANCHORS = 1_000_000
CHARS_AN_ANCHOR = 25
LEAST_BUCKETS = 256


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _whole(words: list[bytes]) -> int:
    """128-bit hash of all words; words hold no space, so equal inputs are equal words."""
    import xxhash

    return xxhash.xxh3_128_intdigest(b" ".join(words))


def _parts(hashes: list[np.ndarray], size: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Parts of documents put together to at most PART_WORDS words (one part may have a window more).

    Gives the words, and for each part the document's number and the part's first word. Windows depend on their own
    words alone, so parts that overlap by size - 1 words have every window of the document, each in one part.
    """
    held, owner, first, n = [], [], [], 0
    for k, h in enumerate(hashes):
        for a in range(0, max(0, len(h) - size + 1), PART_WORDS):
            part = h[a:a + PART_WORDS + size - 1]
            if held and n + len(part) > PART_WORDS + size - 1:
                yield _together(held, owner, first)
                held, owner, first, n = [], [], [], 0
            held.append(part)
            owner.append(k)
            first.append(a)
            n += len(part)
    if held:
        yield _together(held, owner, first)


def _together(held: list[np.ndarray], owner: list[int], first: list[int]) -> tuple[Words, np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    return Words(np.concatenate(held), starts), np.array(owner), np.array(first)


def _anchored(hashes: list[np.ndarray], size: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document number, first word, anchor key and own hash of all windows, part by part."""
    for words, owner, first in _parts(hashes, size):
        at, key = anchors(words, size, rounds)
        part = np.searchsorted(words.starts, at, side="right") - 1
        # under a base of its own, so that anchor and window hash are 128 bits together even where the anchor is the window
        yield owner[part], first[part] + at - words.starts[part], key, words.stretch(at, at + size, BASE_2, INVERSE_2)


def _rows(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Entries as one row a bucket: kind, bucket and the packed bytes of each column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(_starts(bucket)), len(bucket)).tolist()
    return [(kind, int(bucket[x]), *[_pack(c[order[x:y]]) for c in columns]) for x, y in zip(cuts, cuts[1:])]


def _pack(column: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all first ones, then all second ones: equal high bytes compress in the shuffle."""
    return column.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: list[bytes]) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(p, dtype=np.uint8).reshape(8, -1).T).view("<i8")[:, 0] for p in packed if p]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted entries differ from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _sorted_groups(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries sorted by keys and document, where groups of equal keys begin, and each entry's group."""
    order = np.lexsort((doc, *keys[::-1]))
    keys, doc = [k[order] for k in keys], doc[order]
    new = _starts(*keys)
    return (doc, *keys, np.flatnonzero(new), np.cumsum(new) - 1)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % np.uint64(buckets)).astype(np.int64)


def _entries(t: pa.Table, kind: int, column: str) -> np.ndarray:
    """One column of all entries of a kind in a bucket's rows."""
    return _unpack([p for k, p in zip(t.column("kind").to_pylist(), t.column(column).to_pylist()) if k == kind])


def _asked_by(docs: DataFrame, buckets: int, size: int, rounds: int) -> DataFrame:
    """What the documents of a step ask: rows (kind, bucket, keys, other, docs) of packed entries.

    ANCHOR: a symbol that one document of the step has, and that document. A symbol that several have is shared in any
    case: it is sent once without a document, and its documents are told at once (TOLD). WHOLE: the 128-bit hash of all words
    of a document and its id; of copies in the step the smallest id is sent, the others are told (TOLD_COPY). So a
    symbol or a text that a third of all documents have sends its bucket one entry a step; what is told spreads by id.
    """

    def step(c: dict) -> dict:
        ids = c["doc_id"].to_numpy(zero_copy_only=False)
        split = [t.encode().split() for t in c["text"].to_pylist()]
        hashes = [_hashes(w) for w in split]
        found = [(ids[doc[new]], key[new]) for doc, _, key, _ in _anchored(hashes, size, rounds) for new in (_starts(key, doc),)]
        if not found:
            return {n: [] for n in ASKED}
        doc, key = (np.concatenate(x) for x in zip(*found))
        doc, key, first, group = _sorted_groups(doc, key)
        once = _starts(key, doc)
        lone = (np.bincount(group[once]) == 1)[group]
        sent = np.concatenate([key[once & lone], key[first[~lone[first]]]])
        sender = np.concatenate([doc[once & lone], np.full(int((~lone[first]).sum()), NO_ID)])
        out = [(k, b, x, b"", d) for k, b, x, d in _rows(ANCHOR, _bucket(sent, buckets), sent.view(np.int64), sender)]
        told = once & ~lone
        out += [(k, b, x, b"", d) for k, b, x, d in _rows(TOLD, _bucket(_by_doc(doc[told]), buckets), key[told].view(np.int64), doc[told])]
        long = [i for i, h in enumerate(hashes) if len(h) >= size]
        whole = [_whole(split[i]) for i in long]
        one, two = (np.array([x >> shift & (1 << 64) - 1 for x in whole], dtype=np.uint64) for shift in (0, 64))
        doc, one, two, first, group = _sorted_groups(ids[long], one, two)
        out += _rows(WHOLE, _bucket(one[first], buckets), one[first].view(np.int64), two[first].view(np.int64), doc[first])
        later = doc > doc[first][group]
        out += [(k, b, x, b"", d) for k, b, x, d in _rows(TOLD_COPY, _bucket(_by_doc(doc[later]), buckets), one[later].view(np.int64), doc[later])]
        return dict(zip(ASKED, zip(*out)))

    known = docs.filter("doc_id is not null").select("doc_id", "text")
    return arrow_map(known, ASKED_SCHEMA, step, "text", STEP_BYTES)


def _answer(t: pa.Table) -> pa.Table:
    """(doc_id, key, copy) for a bucket: symbols of a document that another has too, and texts that copy an earlier one."""
    doc, key, first, group = _sorted_groups(_entries(t, ANCHOR, "docs"), _entries(t, ANCHOR, "keys"))
    several = np.bincount(group, minlength=len(first)) > 1
    several |= np.bincount(group[doc == NO_ID], minlength=len(first)) > 0
    shared = several[group] & (doc != NO_ID)
    owner, one, _, begin, whole = _sorted_groups(*(_entries(t, WHOLE, n) for n in ("docs", "keys", "other")))
    later = owner > owner[begin][whole]
    docs = np.concatenate([doc[shared], _entries(t, TOLD, "docs"), owner[later], _entries(t, TOLD_COPY, "docs")])
    keys = np.concatenate([key[shared], _entries(t, TOLD, "keys"), one[later], _entries(t, TOLD_COPY, "keys")])
    symbols = int(shared.sum()) + len(_entries(t, TOLD, "docs"))
    return pa.table({"doc_id": docs, "key": keys, "copy": np.arange(len(docs)) >= symbols})


def _is_copy(words: list[bytes], copies: pa.ListScalar, size: int) -> bool:
    """Whether the hash of all words is among those of this id's texts that copy an earlier document word by word.

    Texts were compared by 128 bits; here half of them tell the rows of one id apart.
    """
    if not copies.is_valid or not len(copies) or len(words) < size:
        return False
    half = np.array([_whole(words) & (1 << 64) - 1], dtype=np.uint64)
    return bool(np.isin(half.view(np.int64), copies.values.to_numpy(zero_copy_only=False))[0])


def _windows_asked(docs: DataFrame, buckets: int, size: int, rounds: int) -> DataFrame:
    """What the documents of a step ask about windows whose anchor another document has too; `docs` has their keys.

    Copies of a smaller document ask nothing: that one has the same windows, and they lose all words anyway.
    HELD: anchor, own hash and the smallest document of the step that has the window. The others of the step are told
    at once that it goes (GONE: own hash and document), so a hot passage sends a bucket one entry a step.
    """

    def step(c: dict) -> dict:
        ids = c["doc_id"].to_numpy(zero_copy_only=False)
        lists = c["keys"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = c["keys"].value_lengths().to_numpy(zero_copy_only=False)
        # a document's keys are looked up together with its number
        known = np.unique(lists ^ _by_doc(np.repeat(np.arange(len(ids)), sizes)))
        found = []
        split = [t.encode().split() for t in c["text"].to_pylist()]
        hashes = [_hashes([] if _is_copy(w, x, size) else w) for w, x in zip(split, c["copies"])]
        for doc, _, key, own in _anchored(hashes, size, rounds):
            hit = np.isin(key ^ _by_doc(doc), known)
            found.append((ids[doc[hit]], key[hit], own[hit]))
        out = []
        if found:
            doc, key, own, first, group = _sorted_groups(*(np.concatenate(x) for x in zip(*found)))
            later = (doc > doc[first][group]) & _starts(key, own, doc)
            out = _rows(HELD, _bucket(own[first], buckets), key[first].view(np.int64), own[first].view(np.int64), doc[first])
            out += [(k, b, b"", o, d) for k, b, o, d in _rows(GONE, _bucket(_by_doc(doc[later]), buckets), own[later].view(np.int64), doc[later])]
        return dict(zip(ASKED, zip(*out))) if out else {n: [] for n in ASKED}

    return arrow_map(docs, ASKED_SCHEMA, step, "text", STEP_BYTES)


def _windows_gone(t: pa.Table) -> pa.Table:
    """(doc_id, own) for a bucket: windows of a document that a document with a smaller id has too."""
    doc, _, own, first, group = _sorted_groups(*(_entries(t, HELD, n) for n in ("docs", "keys", "other")))
    later = doc > doc[first][group]
    return pa.table({"doc_id": np.concatenate([doc[later], _entries(t, GONE, "docs")]), "own": np.concatenate([own[later], _entries(t, GONE, "other")])})


def _by_doc(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) + np.uint64(1))


def repeated_windows(keyed: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(k, gone, copies) of documents that lose words; `keyed` has k, doc_id, text.

    gone: hashes of the windows that a smaller doc_id starts too. copies: halves of the 128-bit hashes of whole texts that a
    smaller doc_id has word by word, so that all words go and windows need no look.

    Recompression names runs and pairs by a hash of what they stand for, the same in every task, so naming needs no
    exchange. Symbols that two documents share choose the windows that are then compared by symbol and own hash
    together. Hot symbols and windows reach their buckets once a step of a task, however many documents have them.
    """
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // (CHARS_AN_ANCHOR * BUCKET_ANCHORS))
    answers = _asked_by(keyed, buckets, size, rounds).groupBy("bucket").applyInArrow(_answer, "doc_id bigint, key bigint, copy boolean")
    lists = answers.groupBy(F.col("doc_id").alias("k")).agg(
        F.collect_set(F.when(~F.col("copy"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("copy"), F.col("key"))).alias("copies"))
    lists, _ = written(lists, "shared")
    asked = keyed.join(lists, "k", "left").filter(F.size(F.coalesce("keys", F.array().cast("array<bigint>"))) > 0)
    windows = _windows_asked(asked, buckets, size, rounds).groupBy("bucket").applyInArrow(_windows_gone, "doc_id bigint, own bigint")
    gone = windows.groupBy(F.col("doc_id").alias("k")).agg(F.collect_set("own").alias("gone"))
    return gone.join(lists.filter(F.size("copies") > 0).select("k", "copies"), "k", "full")


def _covered(words: list[bytes], gone: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window whose hash is in `gone`."""
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for part, _, first in _parts([_hashes(words)], size):
        at = part.windows(size)
        hit = at[np.isin(part.stretch(at, at + size, BASE_2, INVERSE_2), gone)] + first[0]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, digest: bool = False, rounds: int = ROUNDS,
                   keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by a space) of every row, and a struct `row` of columns `keep`.

    A word goes if a window of `size` words over it also starts in a document with a smaller id; windows are those of
    the input. With `digest` kept_sha256 stands for kept. NULL or empty text has no words. Rows with a NULL id are
    neither earlier nor later than others: they keep all and take nothing. Rows that repeat an id have equal rank, so
    none removes from the other. Texts cross the network once: both joins by id read the same exchange.
    """
    extra = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    own = F.col(f"`{key}`").cast("bigint")
    keyed = df.select(F.coalesce(own, F.lit(NO_ID)).alias("k"), own.alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *extra)
    last = "kept_sha256" if digest else "kept"
    joined = keyed.join(repeated_windows(keyed, size, rounds), "k", "left").drop("k")

    def step(c: dict) -> dict:
        total, removed, kept = [], [], []
        for t, g, copies, k in zip(c["text"].to_pylist(), c["gone"], c["copies"], c["doc_id"]):
            words = t.encode().split()
            total.append(len(words))
            if k.is_valid and copies.is_valid and _is_copy(words, copies, size):
                words = []
            elif k.is_valid and g.is_valid:
                left = np.flatnonzero(~_covered(words, g.values.to_numpy(zero_copy_only=False).view(np.uint64), size))
                words = [words[i] for i in left.tolist()]
            removed.append(total[-1] - len(words))
            left_text = b" ".join(words)
            kept.append(hashlib.sha256(left_text).hexdigest() if digest else left_text.decode())
        out = {"doc_id": c["doc_id"], "n_words": total, "n_removed": removed, last: kept}
        return out | ({"row": c["row"]} if keep else {})

    schema = f"doc_id bigint, n_words bigint, n_removed bigint, {last} string"
    return arrow_map(joined, schema + (f", {column_type(joined, 'row')}" if keep else ""), step, "text")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, length: str = "n_chars") -> DataFrame:
    """The rows of `docs`, all columns: a text that loses words becomes the words left, joined by a space; others stay.

    The column `length`, if there is one, follows the new text. A text may become empty; no row is dropped.
    """
    found = remove_repeats(docs, key, text, size, keep=docs.columns)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.`{text}`"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: new}
    if length in columns:
        columns[length] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[length].dataType)).otherwise(columns[length])
    return found.select(*[c.alias(n) for n, c in columns.items()])
