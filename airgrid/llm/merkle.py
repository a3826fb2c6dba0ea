"""Merkle manifest: parents keep the SHA-256 state before each child, so that a changed child is folded from there on."""

from __future__ import annotations

import hashlib
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.llm import sha256
from airgrid.llm.common import arrow_map, dropped, reach, written
from airgrid.operators.ordering import attach, value_positions

#: Children of a parent.
FANOUT = 16
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Parents folded together; each has up to 16 leaves.
PARENTS = 512
#: What a node's way up holds for each level: its place among its siblings, the state before it, all digests of its run.
STEP = "struct<slot:int,state:binary,run:binary>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields as bytes: `-` for NULL, else UTF-8 byte count, `:` and value."""
    said = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for f in fields for x in (f.cast("string"),)]
    return F.unhex(F.sha2(F.concat(*said), 256))


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _flat(column: pa.Array) -> np.ndarray:
    """Digests of a binary column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _placed(leaves: DataFrame) -> tuple[DataFrame, list[str]]:
    """Leaves with tree (number of the source, NULL first), idx (place in it, by key and leaf) and n (leaves of the tree).

    Leaves are dealt by ranges of source, key, leaf and row, numbered inside a range, and moved on by the counts of earlier
    ranges, so that a source or a key with most rows spreads.
    """
    sources = value_positions(leaves, [], "source").select("source", F.col("values_before").alias("tree"), "n")
    sources, where = written(sources, "trees")
    rows = attach(leaves, sources, ["source"])
    ranged = rows.repartitionByRange("tree", "key", "leaf", "row").sortWithinPartitions("tree", "key", "leaf", "row")

    class Step:
        """Running count of one task; a task makes its own."""

        def __init__(self):
            self.part, self.tree, self.next = None, None, 0

        def __call__(self, c: dict) -> dict:
            from pyspark import TaskContext

            part, tree = TaskContext.get().partitionId(), c["tree"].to_numpy(zero_copy_only=False)
            if part != self.part:
                self.part, self.tree = part, None
            new = np.ones(len(tree), dtype=bool)
            new[1:] = tree[1:] != tree[:-1]
            first = np.flatnonzero(new)
            idx = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
            if len(tree):
                if tree[0] == self.tree:
                    idx[:first[1] if len(first) > 1 else None] += self.next
                self.tree, self.next = tree[-1], int(idx[-1]) + 1
            return c | {"part": pa.array(np.full(len(tree), part, np.int32)), "inside": pa.array(idx)}

    wanted = ["tree", "n", "key", "leaf", "changed"]
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in wanted) + ", part int, inside bigint"
    numbered, there = written(arrow_map(ranged.select(wanted), schema, Step()), "leaves")
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part")
    counts = counts.select("tree", "part", (F.sum("rows").over(earlier) - F.col("rows")).alias("before"))
    placed = numbered.join(counts, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("inside"))
    return placed.select("tree", "n", "idx", "key", "leaf", "changed"), [where, there]


def _parents(nodes: DataFrame) -> DataFrame:
    """Parents of `nodes` (tree, n, idx, digest): tree, n (parents in the tree), idx, digest, run (digests of the children, one
    after the other) and states (the hash state before each child). Trees of one node have none.
    """
    runs = nodes.filter("n > 1").groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("idx")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("children"))

    def step(c: dict) -> dict:
        counts = c["children"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = _flat(c["children"].flatten())
        first = np.cumsum(counts) - counts
        block = sha256.hex_block(flat)
        state, states = sha256.fresh(len(counts)), np.empty((len(flat), 32), dtype=np.uint8)
        for slot in range(int(counts.max(initial=0))):
            on = np.flatnonzero(counts > slot)
            states[first[on] + slot] = sha256.state_bytes(state[:, on])
            state[:, on] = sha256.compress(state[:, on], block[:, first[on] + slot])
        digests = sha256.finish(state, counts)
        ends = list(zip(first.tolist(), (first + counts).tolist()))
        return {"tree": c["tree"], "n": pa.array((c["n"].to_numpy(zero_copy_only=False) + FANOUT - 1) // FANOUT), "idx": c["idx"],
                "digest": [d.tobytes() for d in digests], "run": [flat[a:b].tobytes() for a, b in ends], "states": [states[a:b].tobytes() for a, b in ends]}

    return arrow_map(runs, "tree bigint, n bigint, idx bigint, digest binary, run binary, states binary", step, step_rows=8 * PARENTS)


def _levels(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], list[str]]:
    """Parents of each level, from those of `nodes` up, each written; `largest` is the largest number of nodes of a tree."""
    levels, folders = [], []
    while largest > 1:
        level, folder = written(_parents(nodes), "parents")
        levels.append(level)
        folders.append(folder)
        nodes, largest = level.select("tree", "n", "idx", "digest"), -(-largest // FANOUT)
    return levels, folders


def _ways(levels: list[DataFrame], tops: DataFrame, lowest: int) -> DataFrame:
    """Ways up of all nodes of level `lowest` (0: what stands below levels[0]): tree, idx, way, subroot.

    `tops` (tree, height, way, subroot) has what follows above a tree's top. Levels are joined from the top down, so the
    rows that carry a way are a sixteenth of those below them.
    """
    def top(level: int) -> DataFrame:
        return tops.filter(F.col("height") == level).select("tree", F.lit(0).cast("bigint").alias("idx"), "way", "subroot")

    ways = top(len(levels))
    for level in range(len(levels) - 1, lowest - 1, -1):
        parents = levels[level].select("tree", "idx", "run", "states")
        slots = F.expr("sequence(0, cast(length(run) / 32 as int) - 1)")
        below = parents.join(ways, ["tree", "idx"]).select("tree", "idx", "run", "states", "way", "subroot", F.explode(slots).alias("slot"))
        step = F.struct("slot", F.expr("substring(states, slot * 32 + 1, 32)").alias("state"), "run")
        below = below.select("tree", (F.col("idx") * FANOUT + F.col("slot")).alias("idx"), F.concat(F.array(step), "way").alias("way"), "subroot")
        ways = below.unionByName(top(level))
    return ways


def _height(n: Column, most: int) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    out, level = F.lit(0), 0
    while FANOUT**level < most:
        out, level = F.when(n > FANOUT**level, level + 1).otherwise(out), level + 1
    return out


def fold(digests: np.ndarray, states: np.ndarray, runs: np.ndarray, counts: np.ndarray, slots: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Digests of parents whose child `slots` is replaced by `digests`: the kept state, the replacement, the right siblings.

    runs (16, parents * 16) are the children's blocks, counts the children of each parent, of the parent of each digest.
    """
    state = sha256.compress(sha256.bytes_state(states), sha256.hex_block(digests))
    right = counts[of] - slots - 1
    for k in range(int(right.max(initial=0))):
        on = np.flatnonzero(right > k)
        state[:, on] = sha256.compress(state[:, on], runs[:, of[on] * FANOUT + slots[on] + 1 + k])
    return sha256.finish(state, counts[of])


def _blocks(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (16, parents * 16) of runs of digests, and how many each has."""
    filled = np.frombuffer(b"".join(r.ljust(32 * FANOUT, b"\0") for r in runs), dtype=np.uint8).reshape(-1, 32)
    return sha256.hex_block(filled), np.array([len(r) // 32 for r in runs])


def _folded(changed: np.ndarray, of: np.ndarray, slot: np.ndarray, first: list, ways: list[list[dict]]) -> np.ndarray:
    """Roots of leaves (n, 32): `of` numbers each leaf's row; `first` has a row's run and states (None: a lone leaf), `ways` the levels above."""
    digests = changed.copy()
    own = np.array([x is not None for x in first])
    on = np.flatnonzero(own[of]) if len(of) else of
    if len(on):
        rows = np.flatnonzero(own)
        runs, counts = _blocks([first[r][0] for r in rows])
        states = np.frombuffer(b"".join(first[r][1].ljust(32 * FANOUT, b"\0") for r in rows), dtype=np.uint8).reshape(-1, FANOUT, 32)
        local = (np.cumsum(own) - 1)[of[on]]
        digests[on] = fold(digests[on], states[local, slot[on]], runs, counts, slot[on], local)
    for level in range(max(map(len, ways), default=0)):
        there = np.array([len(w) > level for w in ways])
        on = np.flatnonzero(there[of])
        steps = [ways[r][level] for r in np.flatnonzero(there)]
        runs, counts = _blocks([s["run"] for s in steps])
        local = (np.cumsum(there) - 1)[of[on]]
        states = np.frombuffer(b"".join(s["state"] for s in steps), dtype=np.uint8).reshape(-1, 32)[local]
        digests[on] = fold(digests[on], states, runs, counts, np.array([s["slot"] for s in steps])[local], local)
    return digests


def manifest(leaves: DataFrame) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root (hex text) and verified of each row of `leaves`.

    `leaves` has source (text), key, leaf (binary digest) and changed (binary; NULL: as leaf). Leaves of a source lie in
    order of key (NULL first) and leaf; every 16 nodes in a row have a parent until one is left, the subroot. Subroots in
    order of the source (NULL first) likewise give the root. A source with one row has its leaf for subroot, one source
    alone its subroot for root. proof_sha256 hashes all siblings, level by level; folded_root is what `changed` gives
    with the siblings as they were, from the states that parents keep. Repeated rows are leaves of their own. An empty
    table gives no rows. The levels stay in the shared folder until it is cleared; `forget` deletes them.
    """
    # numbers of equal rows are written before rows are dealt by them, so that a task run again deals them alike
    leaves, held = written(leaves.select("source", "key", "leaf", "changed", F.monotonically_increasing_id().alias("row")), "leaf-digests")
    placed, folders = _placed(leaves)
    nodes, there = written(placed, "placed")
    folders += [held, there]
    sizes = nodes.filter("idx = 0").select("tree", "n")
    trees, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    largest = largest or 0
    levels, made = _levels(nodes.withColumnRenamed("leaf", "digest"), largest)
    folders += made
    last = nodes.filter("n = 1").select("tree", F.col("leaf").alias("digest"))
    for level in levels:
        last = last.unionByName(level.filter("n = 1").select("tree", "digest"))
    subroots, there = written(last.select(F.lit(0).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("n"), F.col("tree").alias("idx"), "digest"), "subroots")
    upper, made = _levels(subroots, trees)
    folders += [there, *made]
    top = (upper[-1] if upper else subroots).select("digest").first()
    root = bytes(top[0]) if top else b""
    above = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(len(upper)).alias("height"), F.expr(f"cast(array() as array<{STEP}>)").alias("way"),
                            F.lit(None).cast("binary").alias("subroot")).limit(1)
    above = _ways(upper, above, 0).select(F.col("idx").alias("tree"), "way")
    tops = subroots.select(F.col("idx").alias("tree"), F.col("digest").alias("subroot")).join(above, "tree").join(sizes, "tree")
    tops, there = written(tops.select("tree", "way", "subroot", _height(F.col("n"), max(largest, 1)).alias("height")), "tops")
    folders.append(there)
    members = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "key", "leaf", "changed"))).alias("members"))
    lone = tops.filter("height = 0").select("tree", F.lit(0).cast("bigint").alias("idx"), F.lit(None).cast("binary").alias("run"), F.lit(None).cast("binary").alias("states"), "way", "subroot")
    rows = lone
    if levels:
        rows = levels[0].select("tree", "idx", "run", "states").join(_ways(levels, tops, 1), ["tree", "idx"]).unionByName(lone)
    rows = members.join(rows, ["tree", "idx"]).select("members", "run", "states", "way", "subroot")
    kind = leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    out = arrow_map(rows, schema, lambda c: _rows(c, root), step_rows=PARENTS)
    out._folders = folders
    return out


def forget(found: DataFrame) -> None:
    """Delete what a manifest stands on, once it has been read."""
    for folder in found._folders:
        dropped(found.sparkSession, folder)


def _rows(c: dict, root: bytes) -> dict:
    """Result rows of some parents."""
    members = [m for m in c["members"].to_pylist()]
    ways, subroot = c["way"].to_pylist(), c["subroot"].to_pylist()
    first = [None if r is None else (r, s) for r, s in zip(c["run"].to_pylist(), c["states"].to_pylist())]
    of = np.repeat(np.arange(len(members)), [len(m) for m in members])
    slot = np.concatenate([np.arange(len(m)) for m in members]) if members else of
    flat = [x for m in members for x in m]
    changed = np.frombuffer(b"".join(x["changed"] or x["leaf"] for x in flat), dtype=np.uint8).reshape(-1, 32)
    folded = [d.tobytes() for d in _folded(changed, of, slot, first, ways)]
    proofs = []
    for f, way, m in zip(first, ways, members):
        upper = b"".join(_but(s["run"], s["slot"]) for s in way)
        proofs += [hashlib.sha256((_but(f[0], i) if f else b"") + upper).hexdigest() for i in range(len(m))]
    return {"key": [x["key"] for x in flat], "leaf": [x["leaf"].hex() for x in flat], "subroot": [subroot[i].hex() for i in of], "root": [root.hex()] * len(flat),
            "proof_sha256": proofs, "folded_root": [x.hex() for x in folded], "verified": [x == root for x in folded]}


def _but(run: bytes, slot: int) -> bytes:
    """Hex text of a run of digests without one."""
    return (run[:32 * slot] + run[32 * slot + 32:]).hex().encode()


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """Leaves of `docs` for `manifest`; where `tampered` holds, `changed` is the leaf of the row with its text's A-Z in lower case."""
    reach(docs.sparkSession)
    own = [F.col(f"`{f}`") for f in fields]
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf_digest([lowered(f) if n == text else f for n, f in zip(fields, own)]))
    return docs.select(F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("key"), leaf_digest(own).alias("leaf"), changed.alias("changed"))


def tampered_fifth(key: Column) -> Column:
    """Rows whose id's decimal text has an unsigned CRC-32 that 5 divides; never a NULL id."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
