"""SentencePiece ids and texts through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, kept_by_worker

MARK = "▁"
#: A marked word: white space markers and what follows them up to the next marker.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: Marked words a worker remembers before it starts anew; bounds its memory, changes no result.
REMEMBERED = 300_000


@kept_by_worker
def open_pieces(path: str) -> Pieces:
    return Pieces(path)


class Pieces:
    """Ids and decoded text of whole texts, exactly as the library gives them.

    Where no piece holds a marker after another character, merges never cross the start of a marked word, so a text's
    ids are those of its marked words in turn, and decoding goes word by word too (bytes never run across a marker).
    That, the marker put before a text and white space kept as it stands are checked when the model is opened; a model
    that fails gets whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        probe = "  a  b \n c"
        self.by_word = (not any(crossing.search(m.id_to_piece(i)) for i in range(m.get_piece_size()))
                        and m.decode(m.encode(probe)) == probe and m.encode("b")[0] == m.encode("a b")[-1])
        self.known: dict[str, tuple[str, int, str]] = {}

    def _look_up(self, chunks: list[str]) -> None:
        bodies = [c[1:] for c in chunks]
        ids = self.model.encode(bodies, num_threads=1)
        lone = [self.model.piece_to_id(MARK)]
        ids = [i if b else lone for i, b in zip(ids, bodies)]
        texts = self.model.decode(ids, num_threads=1)
        self.known.update((c, (",".join(map(str, i)), len(i), t)) for c, i, t in zip(chunks, ids, texts))

    def texts(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """Decimal ids joined by commas, their number and the decoded text, of each text; NULL counts as empty."""
        if not self.by_word:
            ids = [self.model.encode(t or "") for t in texts]
            return [(",".join(map(str, i)), len(i), self.model.decode(i)) for i in ids]
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        chunks = set().union(*split)
        new = chunks - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, chunks
        if new:
            self._look_up(list(new))
        out = []
        for s in split:
            found = list(map(self.known.__getitem__, s))
            out.append((",".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out


def encode_and_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """key (bigint), n_tokens, ids (array<int>) and decoded text of every row; no shuffle.

    With `digests` the SHA-256 of the comma-joined decimal ids and of the decoded text stand in for both. NULL or empty
    text has no ids and an empty decoded text. Repeated rows are encoded each; other columns are not read.
    """
    real = f"`{key}` bigint, n_tokens bigint, ids array<int>, decoded string"
    short = f"`{key}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def step(c: dict) -> dict:
        found = open_pieces(path).texts(c["text"].to_pylist())
        out = {key: c["key"], "n_tokens": [n for _, n, _ in found]}
        if digests:
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            return out | {"ids_sha256": [sha(i) for i, _, _ in found], "decoded_sha256": [sha(t) for _, _, t in found]}
        return out | {"ids": [[int(x) for x in i.split(",")] if i else [] for i, _, _ in found], "decoded": [t for _, _, t in found]}

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return arrow_map(rows, short if digests else real, step, "text")
