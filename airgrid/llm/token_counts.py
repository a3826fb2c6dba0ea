"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both sides must agree."""

from __future__ import annotations

import json
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, kept_by_worker
from airgrid.llm.word_ids import Recent, open_tokenizer

#: Texts above CHUNK + OVERLAP characters are cut; the overlap doubles until both sides agree.
CHUNK = 32_768
OVERLAP = 256
#: A place that no token crosses, whatever stands further left or right: from a visible character to white space. The
#: byte-level pattern lets a token hold white space only at its start, and has no look-behind.
STABLE = re.compile(r"(?<=[^\s\x1c-\x1f])[ \t\n\r]")
#: Stretches between stable places, in texts whose white space is all of the four kinds; other texts are encoded whole.
STRETCH = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
#: A stretch of one space at most, Latin letters and marks: the pattern always parts letters from marks other than "'".
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
#: Entries of the tables that a worker keeps: stretches, and parts of plain ones.
STRETCHES_KEPT, PARTS_KEPT = 150_000, 300_000


#: Fixed value: what a tokenizer file must say for texts to be cut, namely the byte-level splitter alone and no normaliser.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def may_be_cut(tokenizer) -> bool:
    """Whether the file names the splitter that STABLE and PLAIN are about, and no special string holds or takes white space."""
    said = json.loads(tokenizer.to_str())
    split = said.get("pre_tokenizer") or {}
    specials = tokenizer.get_added_tokens_decoder().values()
    return said.get("normalizer") is None and all(split.get(k) == v for k, v in SPLITTER.items()) and \
        not any(t.lstrip or t.rstrip or t.normalized or t.single_word or re.search(r"\s", t.content) or PLAIN.match(t.content) for t in specials)


@kept_by_worker
def open_counts(path: str) -> Counts:
    return Counts(open_tokenizer(path))


class Counts:
    """Tokens of texts of ordinary length: a text is the sum of its stretches, each distinct one encoded about once.

    With a tokenizer whose file does not prove that this changes nothing (`cuts` is False), texts are encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.cuts = tokenizer, may_be_cut(tokenizer)
        self.stretches, self.parts = Recent(self._stretch, STRETCHES_KEPT), Recent(self._encode, PARTS_KEPT)

    def _encode(self, text: str) -> int:
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]) if text else 0

    def _stretch(self, text: str) -> int:
        plain = PLAIN.fullmatch(text)
        return self.parts[plain[1]] + self.parts[plain[2]] if plain else self._encode(text)

    def text(self, text: str) -> int:
        if not self.cuts or OTHER_SPACE.search(text):
            return self._encode(text)
        return sum(map(self.stretches.__getitem__, STRETCH.findall(text)))


def _spans(tokenizer, text: str) -> tuple[list[int], set[int]]:
    offsets = tokenizer.encode(text, add_special_tokens=False).offsets
    return [a for a, _ in offsets], {b for _, b in offsets}


def count_tokens(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, equal to encoding it whole.

    Chunk [a, b) is encoded up to b + overlap, the next one from b. A place p in the overlap serves as splice if it is
    stable by the pattern and a token ends there in both encodings: the left one counts up to p, the right one from p.
    Without such a place the overlap doubles, at last to the end of the text, which is then counted whole.
    """
    total, start, counted_from = 0, 0, 0
    while True:
        end = start + chunk
        if end + overlap >= len(text):
            starts, _ = _spans(tokenizer, text[start:])
            return total + len(starts) - bisect_left(starts, counted_from - start)
        width = overlap
        while True:
            stop = min(end + width, len(text))
            starts, ends = _spans(tokenizer, text[start:stop])
            if stop == len(text):
                return total + len(starts) - bisect_left(starts, counted_from - start)
            _, right_ends = _spans(tokenizer, text[end:stop])
            p = next((m.start() for m in STABLE.finditer(text, end + 1, stop) if m.start() > counted_from
                      and m.start() - start in ends and m.start() - end in right_ends), None)
            if p is not None:
                break
            width *= 2
        total += bisect_left(starts, p - start) - bisect_left(starts, counted_from - start)
        start, counted_from = end, p


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key (bigint), n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row; no shuffle.

    NULL or empty text counts zero. Texts are cut only for tokenizers with the byte-level splitter (`may_be_cut`); others
    get every text whole. Special strings inside a text count as the library's default says. Repeated rows
    are counted each; other columns are not read.
    """

    def step(c: dict) -> dict:
        tokenizer = open_tokenizer(path)
        texts = [t or "" for t in c["text"].to_pylist()]
        counts = open_counts(path)
        n = [counts.text(t) if len(t) <= CHUNK + OVERLAP or not counts.cuts else count_tokens(tokenizer, t) for t in texts]
        return {key: c["key"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return arrow_map(rows, f"`{key}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", step, "text")
