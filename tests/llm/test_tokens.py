import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from airgrid.llm import pieces, token_counts, token_files, word_ids
from airgrid.llm.common import vocabulary
from airgrid.llm.registry import QUERIES
from tests.llm.cases import EDGES, FOLDER, edges, exact, rows_of

WORDS, BYTES, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def odd_texts(n=1500):
    rng = random.Random(5)
    signs = list("ab Zé\n\t\r '’sS<|>▁  ́  \x1c\x85\x0b\x0cßΣς1२½!?.,≠，ﬁＡ한글🙂‍\x00") + ["<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<0x0A>", "  ", "'s", "'LL", "don't", "a,b"]
    return ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(n)] + ["", " ", "  ", "\n", LONG_WORD]


LONG_WORD = "ab" * 3000


def whole_ids(docs, end):
    tokenizer = Tokenizer.from_file(WORDS)
    return [(k, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4")) for k, t in docs]


def test_word_ids_equal_the_library():
    texts = odd_texts()
    for kept in (word_ids.WORDS_KEPT, 20):
        table = word_ids.WordIds(WORDS)
        table.words.most = kept
        ids, at = table.texts(pa.array(texts), 2)
        assert table.by_word and table.bare
        assert [x.tobytes() for x in (ids[a:b] for a, b in zip(at, at[1:]))] == [x.tobytes() for _, x in whole_ids(enumerate(texts), 2)]


def test_words_go_to_the_tokenizer_in_lines(monkeypatch):
    """Plain words are not encoded one by one; a tokenizer whose ids do not tell words apart gets them so."""
    rng, alone = random.Random(8), []
    one = word_ids.WordIds._word
    monkeypatch.setattr(word_ids.WordIds, "_word", lambda self, w: alone.append(w) or one(self, w))
    words = ["".join(rng.choices("aehinorstußé", k=rng.randint(1, 14))) for _ in range(5000)] + [LONG_WORD]
    texts = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)] + ["", None, "A,b 12 <|endoftext|>"]
    ids, at = word_ids.WordIds(WORDS).texts(pa.array(texts), 2)
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == [x.tobytes() for _, x in whole_ids(enumerate(texts), 2)]
    assert not alone


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_words_whose_ends_no_id_tells(tmp_path, suffix):
    """Without a mark of ends, and with letters that the vocabulary lacks (the library drops them)."""
    import json

    said = json.loads(open(WORDS).read())
    known = [x + y for x in "abc" for y in (["", suffix] if suffix else [""])]
    known = [x for x in known if x != "c</w>"] + ["a" + "b" + suffix]
    said["model"] |= {"vocab": {x: i for i, x in enumerate(known)}, "merges": [["a", "b" + suffix]], "end_of_word_suffix": suffix or None}
    said["added_tokens"] = []
    path = str(tmp_path / "t.json")
    with open(path, "w") as f:
        json.dump(said, f)
    library, table = Tokenizer.from_file(path), word_ids.WordIds(path)
    texts = ["ab ba cab", "abc c cc", "c", "a b ab abab d da", ""]
    ids, at = table.texts(pa.array(texts))
    assert table.by_word and (table.lines is None) == (not suffix)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_table_of_many_keys_is_bounded():
    asked = []
    table = word_ids.Recent(None, 3)
    for keys in ([1, 2], [2, 3, 4, 5, 6, 7, 8], [], [8, 1], [7, 9]):
        assert table.many(keys, lambda new: asked.append(list(new)) or [-k for k in new]) == [-k for k in keys]
        assert len(table) <= 3 and len(table.older) <= 3
    assert asked == [[1, 2], [3, 4, 5, 6, 7, 8], [], [1], [9]]


def test_word_ids_of_a_tokenizer_whose_tokens_hold_white_space():
    table, library = word_ids.WordIds(BYTES), Tokenizer.from_file(BYTES)
    texts = odd_texts(50) + [None]
    ids, at = table.texts(pa.array(texts))
    assert not table.by_word
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_query(spark):
    start, expected = 0, []
    for k, ids in whole_ids(rows_of("documents", "doc_id, text"), 2):
        expected.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert exact(QUERIES["op6_token_files"](spark, FOLDER).collect()) == exact(expected)


@pytest.mark.parametrize("extra", [False, True])
def test_token_files_of_edges(spark, tmp_path, extra):
    path = str(tmp_path / "ids")
    token_files.write_ids(edges(spark, extra), path, WORDS)
    expected = whole_ids([(k, t) for k, t, _, _ in EDGES], 2)
    rows = token_files.read_ids(spark, path).collect()
    assert exact((r.doc_id, r.ids) for r in rows) == exact((k, x.tolist()) for k, x in expected)
    files = token_files.read_ids(spark, path)
    starts = token_files.with_starts(files, files).orderBy("start").collect()
    assert [r.start for r in starts] == [0, *np.cumsum([r.n_tokens for r in starts])[:-1].tolist()]
    known = [r.doc_id for r in starts if r.doc_id is not None]
    assert known == sorted(known)
    assert exact((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.checksums(files).collect()) == exact(
        (k, len(x), zlib.crc32(x.tobytes())) for k, x in expected)


def test_token_files_prune_by_id(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(edges(spark), path, WORDS)
    found = token_files.read_ids(spark, path, [10, 12, 999])
    assert sorted(r.doc_id for r in found.collect()) == [10, 12]
    assert "In(doc_id, [10,12,999])" in found._jdf.queryExecution().executedPlan().toString()
    import pyarrow.orc as orc

    files = [f for f in (tmp_path / "ids").iterdir() if f.suffix == ".orc"]
    assert files and all(orc.ORCFile(f).nstripes >= 1 for f in files)


def test_token_files_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(edges(spark).limit(0), path, WORDS)
    files = token_files.read_ids(spark, path)
    assert token_files.with_starts(token_files.checksums(files), files).count() == 0


def test_pieces_equal_the_library():
    library, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), odd_texts()
    table = pieces.Pieces(PIECES)
    assert table.by_word
    for t, found in zip(texts, table.texts(texts)):
        ids = library.encode(t)
        assert found == (",".join(map(str, ids)), len(ids), library.decode(ids)), t


def test_pieces_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(k, len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for k, t in rows_of("documents", "doc_id, text") for i in (library.encode(t or ""),)]
    assert exact(QUERIES["op8_sentencepiece"](spark, FOLDER).collect()) == exact(expected)


@pytest.mark.parametrize("extra", [False, True])
def test_pieces_of_edges(spark, extra):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = [(k, len(i), i, library.decode(i)) for k, t, _, _ in EDGES for i in (library.encode(t or ""),)]
    assert exact(pieces.encode_and_decode(edges(spark, extra), PIECES).collect()) == exact(expected)
    assert pieces.encode_and_decode(edges(spark).limit(0), PIECES).count() == 0


def test_counts_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    table = token_counts.Counts(library)
    for t in odd_texts():
        assert table.text(t) == len(library.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (100, 1), (1000, 16)])
def test_spliced_chunks_count_as_the_whole(chunk, overlap):
    library = Tokenizer.from_file(BYTES)
    texts = ["".join(odd_texts(60)), "x" * 900, "ab " * 500, "y" * 300 + " " + "z" * 900 + " " * 300 + "q", "one\n\n\ntwo  three 'tis\t" * 60, "word " * 13 + "v" * 2000, "", "a"]
    for t in [*texts, *odd_texts(100)]:
        assert token_counts.count_tokens(library, t, chunk, overlap) == len(library.encode(t, add_special_tokens=False).ids)


def test_counts_query(spark):
    library = Tokenizer.from_file(BYTES)
    expected = [(k, len(t.encode()), n, n > 1024) for k, t in rows_of("documents", "doc_id, text") for n in (len(library.encode(t, add_special_tokens=False).ids),)]
    assert exact(QUERIES["op10_token_counts"](spark, FOLDER).collect()) == exact(expected)


@pytest.mark.parametrize("extra", [False, True])
def test_counts_of_edges(spark, extra):
    library = Tokenizer.from_file(BYTES)
    expected = [(k, len((t or "").encode()), n, n > 1024) for k, t, _, _ in EDGES for n in (len(library.encode(t or "", add_special_tokens=False).ids),)]
    assert exact(token_counts.token_counts(edges(spark, extra), BYTES).collect()) == exact(expected)
    assert token_counts.token_counts(edges(spark).limit(0), BYTES).count() == 0


def test_unknown_tokenizers_get_whole_texts(spark, tmp_path):
    """Tokens that hold white space in their middle, and splitters that no file names as known."""
    from tokenizers import models, normalizers, pre_tokenizers

    alphabet = {c: i for i, c in enumerate("ab c")} | {"a ": 4, "a b": 5}
    plain = Tokenizer(models.BPE(vocab=alphabet, merges=[("a", " "), ("a ", "b")]))
    lower = Tokenizer.from_file(BYTES)
    lower.normalizer = normalizers.Lowercase()
    prefixed = Tokenizer.from_file(BYTES)
    prefixed.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    texts = ["a b a b c", "a b " * 30, "A  b\ta", "", None, "a b c " * 9_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for k, made in enumerate((plain, lower, prefixed)):
        path = str(tmp_path / f"{k}.json")
        made.save(path)
        library = Tokenizer.from_file(path)
        assert not token_counts.may_be_cut(library) and not word_ids.WordIds(path).by_word
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path).collect()}
        assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_counts.may_be_cut(Tokenizer.from_file(BYTES))
