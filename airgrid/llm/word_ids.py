"""Token ids of whole texts, with each distinct word given to the tokenizer about once a worker, many words at a time."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from airgrid.llm.common import kept_by_worker

#: White space at which a text may be cut; all of it is white space to every tokenizer.
CUTS = "\t\n\r"
#: Words of the table that a worker keeps (a full table steps back and is asked once more).
WORDS_KEPT = 120_000
#: Bytes of text numbered at once: the more, the fewer words are looked up again.
NUMBERED_BYTES = 6_000_000
#: Words given to the tokenizer at once.
WORDS_AT_ONCE = 1_000
#: Lower-case Latin letters that composition and lower-casing leave alone.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
#: A letter and a mark other than "'", between which the known splitter always cuts, so that a space there changes no id.
CUT_HERE = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~])"
#: What every special string begins with; texts that have it are split at white space alone.
SPECIAL = "<|"
#: What a tokenizer file must say for CUT_HERE and for lower-casing A-Z beforehand.
NORMALISER = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Recent(dict):
    """Values made on first use. A table of `most` entries is set aside and asked before a value is made again."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def many(self, keys: list, make_all) -> list:
        """Values of distinct keys in turn; `make_all` makes those that neither table has, given as a list."""
        found = list(map(self.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        older = self.older
        for i in gaps:
            found[i] = older.get(keys[i])
        new = [i for i in gaps if found[i] is None]
        for i, v in zip(new, make_all([keys[i] for i in new]), strict=True):
            found[i] = v
        while gaps:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            room = max(self.most - len(self), 1)
            self.update((keys[i], found[i]) for i in gaps[:room])
            gaps = gaps[room:]
        return found


@cache
def open_tokenizer(path: str):
    """The library's tokenizer, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@kept_by_worker
def open_words(path: str) -> WordIds:
    return WordIds(path)


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers, exactly as the library gives them for the whole text.

    If the tokenizer's file names the known normaliser and splitter, which drop white space and let no token cross it, a
    text has the ids of its words in turn: words are lower-cased and parted from their marks, and plain ones go to the
    model without both, in lines of many. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = open_tokenizer(path)
        self.bare = self._without_splitter()
        self.by_word = self.bare is not None
        self.lines, self.ends = self._of_lines() if self.by_word else (None, None)
        self.words = Recent(self._word, WORDS_KEPT)

    def _without_splitter(self):
        said = json.loads(self.tokenizer.to_str())
        normaliser = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        if normaliser != NORMALISER or split.get("pattern") != {"Regex": SPLITTER} or [x.get("type") for x in rest] != ["ByteLevel"]:
            return None
        specials = self.tokenizer.get_added_tokens_decoder().values()
        if any(not t.content.startswith(SPECIAL) or t.lstrip or t.rstrip for t in specials) or not split.get("invert") or rest[0].get("use_regex") or rest[0].get("add_prefix_space"):
            return None
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        bare = Tokenizer.from_str(self.tokenizer.to_str())
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return bare

    def _of_lines(self):
        """`bare` for words with a space between them, and whether each id can end a word (None: ids do not say)."""
        from tokenizers import Tokenizer, pre_tokenizers

        lines = Tokenizer.from_str(self.bare.to_str())
        suffix = json.loads(lines.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None, None
        lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), lines.pre_tokenizer])
        known = lines.get_vocab()
        ends = np.zeros(max(known.values()) + 1, bool)
        ends[[i for token, i in known.items() if token.endswith(suffix)]] = True
        return lines, ends

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word):
            return self._encode(word)
        return array("I", self.bare.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """`_word` of many words; plain ones go to the model in lines."""
        if self.lines is None:
            return [self._word(w) for w in words]
        found = [None if PLAIN.fullmatch(w) else self._encode(w) for w in words]
        plain = [i for i, v in enumerate(found) if v is None]
        for start in range(0, len(plain), WORDS_AT_ONCE):
            at = plain[start:start + WORDS_AT_ONCE]
            line = [words[i] for i in at]
            ids = np.array(self.lines.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, dtype="<u4")
            upto = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(upto) != len(line):  # the last token of a word is not in the vocabulary
                for i, w in zip(at, line, strict=True):
                    found[i] = self._word(w)
                continue
            data = ids.tobytes()
            for i, a, b in zip(at, [0, *upto], upto):
                found[i] = data[a:b]
        return found

    def texts(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after the other, and where each text's begin and the last one's end.

        NULL counts as empty; `end_id` follows each text's ids. Words are split and numbered by Arrow, so the tables are
        asked once for each distinct word of the column.
        """
        texts = pc.fill_null(texts, "")
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        if not self.by_word:
            found = [self._encode(t) + end for t in texts.to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in found])
            return np.frombuffer(b"".join(found), dtype="<u4"), ends
        for c in CUTS:
            texts = pc.replace_substring(texts, c, " ")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), CUT_HERE, r"\1 \2")
        special = pc.match_substring(texts, SPECIAL)
        texts = pc.if_else(special, texts, parted) if pc.any(special).as_py() else parted
        split = pc.split_pattern(texts, " ")
        numbered = split.flatten().dictionary_encode()
        found = [end, *self.words.many(numbered.dictionary.to_pylist(), self._words)]
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        words = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        word = np.insert(numbered.indices.to_numpy(zero_copy_only=False) + 1, words, 0)
        length = size[word]
        upto = np.cumsum(length, dtype=np.int64)
        narrow = np.int32 if len(upto) and upto[-1] < 1 << 30 and len(ids) < 1 << 30 else np.int64
        first = ((np.cumsum(size) - size)[word] - (upto - length)).astype(narrow)
        at = np.repeat(first, length)
        at += np.arange(len(at), dtype=narrow)
        return ids[at], np.concatenate([[0], upto[words + np.arange(len(words))]])
