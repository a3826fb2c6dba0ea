"""Language identification by fusing evidence: text, declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, row_hash, without_rows, written

#: Labelled rows that the text model is fitted on, about; a hash of the rows picks them. Everything else reads all rows.
TRAIN_ROWS = 20_000
#: Every declared language is told apart. Those with a smaller share of the labelled rows are smoothed towards all rows
#: instead of evenly, and get rows of their own: TRAIN_ROWS more, dealt evenly among them.
LEAST_SHARE = 0.002
#: Languages whose trigrams are looked up at once, and numbers of a matrix of rows and languages.
LANGUAGE_BLOCK = 64
STEP_CELLS = 1_000_000
#: Bytes of text whose trigrams are looked up at once.
STEP_BYTES = 1_000_000
#: Hashed byte trigrams of the text model; log-probabilities are whole numbers of this fraction, so sums have no order.
FEATURES = 1 << 15
GRAIN = 1024
#: Trigrams overlap and repeat, so their evidence counts in part only.
TEMPER = 0.25
#: Pseudo-rows that a host inherits from its domain and a domain from all rows, and of unseen declared values and suffixes.
INHERITED = 20.0
UNSEEN = 0.5
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and how many each text has: lower-case UTF-8 bytes, anything but letters a space."""
    parts = [(" " + t.lower() + " ").encode("utf-8", "replace") if t else b"" for t in texts]
    sizes = np.array([max(0, len(p) - 2) for p in parts], dtype=np.int64)
    raw = _LETTER[np.frombuffer(b"".join(parts), dtype=np.uint8)].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    feature = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    lone = (raw[1:-1] == 0) | ((raw[:-2] == 0) & (raw[2:] == 0) & (raw[1:-1] == 0))
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(len(raw) - 2, dtype=bool)
    for cut in (ends - 2, ends - 1):
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    ok = inside & ~lone
    owner = np.repeat(np.arange(len(parts)), sizes)
    counts = np.bincount(owner[ok[inside]], minlength=len(parts)) if len(owner) else np.zeros(len(parts), dtype=np.int64)
    return feature[ok].astype(np.int64), counts


def primary(declared: Column) -> Column:
    """Primary subtag of a language tag in lower case; NULL if there is none."""
    tag = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    return F.when(tag != "", tag)


class TextModel:
    """Whole-number log-probabilities of trigrams by language, in blocks of languages; `rare` marks languages smoothed towards all."""

    def __init__(self, languages: list[str], counts: np.ndarray, rare: np.ndarray | None = None):
        self.languages, self.blocks = languages, []
        overall = counts.sum(axis=0) + 0.5
        overall *= 0.5 * FEATURES / overall.sum()
        for at in range(0, len(languages), LANGUAGE_BLOCK):
            smooth = counts[at:at + LANGUAGE_BLOCK] + 0.5
            if rare is not None:
                thin = rare[at:at + LANGUAGE_BLOCK]
                smooth[thin] += overall - 0.5
            self.blocks.append(np.rint(GRAIN * np.log(smooth / smooth.sum(axis=1, keepdims=True))).astype(np.int32).T.copy())

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and its number of trigrams."""
        feature, counts = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            begins = np.cumsum(counts[some]) - counts[some]
            for k, block in enumerate(self.blocks):
                at = k * LANGUAGE_BLOCK
                out[some, at:at + LANGUAGE_BLOCK] = np.add.reduceat(block[feature], begins, axis=0, dtype=np.int64)
        return out, counts


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel | None:
    """Fit the text model on rows (text, declared); None if no row is labelled. Collects languages x FEATURES counts at most."""
    known = {r["declared"]: r["count"] for r in rows.groupBy("declared").count().collect() if r["declared"]}
    total = sum(known.values())
    languages = sorted(known)
    if not languages:
        return None
    rare = np.array([known[x] < LEAST_SHARE * total for x in languages])
    share = min(1.0, train_rows / total)
    upto = int(share * (1 << 20)) + 1
    picked = F.pmod(F.xxhash64("text", "declared"), F.lit(1 << 20))
    limit = F.lit(upto)
    thin = [x for x, r in zip(languages, rare) if r or known[x] * share < LEAST_SHARE * TRAIN_ROWS]
    if thin and share < 1:
        # at least the smallest hash of each of them, so that no language is left without a row
        own = max(1, train_rows // len(thin))
        first = rows.filter(F.col("declared").isin(thin)).groupBy("declared").agg(F.min(picked).alias("first")).collect()
        upto_of = {x: max(upto, least + 1, int(own / known[x] * (1 << 20)) + 1) for x, least in first}
        limit = F.coalesce(F.create_map(*[F.lit(y) for x in upto_of.items() for y in x])[F.col("declared")], limit)
    sample = rows.filter(F.col("declared").isNotNull() & (picked < limit))

    def step(c: dict) -> dict:
        feature, counts = trigrams(c["text"].to_pylist())
        at = {x: i for i, x in enumerate(languages)}
        code = np.array([at[x] for x in c["declared"].to_pylist()], dtype=np.int64)
        key, n = np.unique(np.repeat(code, counts) * FEATURES + feature, return_counts=True)
        return {"key": pa.array(key), "n": pa.array(n)}

    counted = arrow_map(sample.select("text", "declared"), "key bigint, n bigint", step, "text", STEP_BYTES).groupBy("key").agg(F.sum("n").alias("n"))
    table = np.zeros(len(languages) * FEATURES)
    for key, n in counted.toLocalIterator():
        table[key] = n
    return TextModel(languages, table.reshape(len(languages), FEATURES), rare)


class Scored:
    """Rows with the text's log-likelihoods (scores), best language (-1 without a letter), a number (at) and the columns carried along."""

    def __init__(self, rows: DataFrame, languages: list[str]):
        self.rows, self.languages = rows, languages


def score(df: DataFrame, text: Column, declared: Column, carry: dict[str, Column], train_rows: int = TRAIN_ROWS) -> Scored:
    """Fit the text model on declared languages, score every text and write the scores; texts are not shuffled.

    With no labelled row there are no languages, and best is 0 for a text with a letter.
    """
    rows = df.select(text.alias("text"), primary(declared).alias("label"), F.struct(*[c.alias(n) for n, c in carry.items()]).alias("row"))
    model = fit(rows.select("text", F.col("label").alias("declared")), train_rows)
    if model is None:
        best = F.when(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), 0).otherwise(-1)
        return Scored(rows.select("row.*", best.alias("best"), F.array().cast("array<bigint>").alias("scores")), [])

    def step(c: dict) -> dict:
        s, counts = model.scores(c["text"].to_pylist())
        best = np.where(counts > 0, s.argmax(axis=1), -1)
        return {"row": c["row"], "best": pa.array(best.astype(np.int32)), "scores": list(s)}

    schema = f"row {rows.schema['row'].dataType.simpleString()}, best int, scores array<bigint>"
    scored = arrow_map(rows.select("row", "text"), schema, step, "text", STEP_BYTES)
    scored, _ = written(scored.withColumn("at", F.monotonically_increasing_id()), "scores")
    return Scored(scored.select("row.*", "at", "best", "scores"), model.languages)


#: What one page (or a row by itself) says of its language, and how many pages say so.
SEEN = "array<struct<declared:string,suffix:string,host:string,n:bigint>>"


def fuse(scored: Scored, declared: Column, seen: Column, key: Column) -> DataFrame:
    """key, language, posterior (double), text_language, declared and kept of every scored row.

    `seen` is an array as SEEN. Log-likelihoods of the text under each language, of the declared languages and of the
    address suffixes given the language, and a host prior are added and normalised. All pages of a row count: they share
    the weight of one in the likelihoods, by their numbers, and the counts of their hosts, and of their domains, are
    added. The prior of hosts inherits from their domains (last two labels) and that from all rows, by pseudo-counts;
    counts are a grouped aggregation of what the text alone says over all rows, where a row votes once for each of its
    hosts, domains, suffixes and declared languages, and a row's own votes are taken out of them. NULL declared language,
    suffix or host is no evidence, nor is a suffix without a host. language is `und` and posterior 0 for a text without a letter (NULL and empty ones too).
    kept: the text has a letter and the posterior is at least LEAST_POSTERIOR, or no row of the table is labelled, so that
    nothing can be told. Rows stand alone, ties go to the language first by name; `key` need not be unique.
    """
    languages, n = scored.languages, len(scored.languages)
    if not n:
        return scored.rows.select(key.alias("key"), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(UNKNOWN).alias("text_language"),
                                  primary(declared).alias("declared"), (F.col("best") >= 0).alias("kept"))
    low = F.transform(seen.cast(SEEN), lambda x: F.struct(primary(x["declared"]).alias("declared"), F.lower(x["suffix"]).alias("suffix"), F.lower(x["host"]).alias("host"), x["n"].alias("n")))
    scored = scored.rows.select(key.alias("key"), primary(declared).alias("declared"), low.alias("seen"), "at", "best", "scores")
    kind = scored.schema["key"].dataType.simpleString()
    told = scored.filter("best >= 0").select("at", "best", "seen")
    said = told.select("best", F.explode(F.expr("array_distinct(filter(transform(seen, x -> x.declared), x -> x is not null))")).alias("declared"))
    named = {x: i for i, x in enumerate(languages)}
    confusion = np.full((n + 1, n), UNSEEN)
    for d, best, k in said.groupBy("declared", "best").count().collect():
        confusion[named.get(d, n), best] += k
    log_declared = np.log(confusion / confusion.sum(axis=0))
    everywhere = np.zeros(n)
    for best, k in told.groupBy("best").count().collect():
        everywhere[best] = k

    # (kind, name) of each distinct host, domain and suffix of a row, with the number of its pages
    links = told.withColumn("seen", F.expr("filter(seen, x -> x.host is not null)")).withColumn("names", F.expr("""concat(
        transform(seen, x -> struct('h' AS kind, x.host AS name, x.n AS n)),
        transform(seen, x -> struct('d' AS kind, substring_index(x.host, '.', -2) AS name, x.n AS n)),
        transform(filter(seen, x -> x.suffix is not null), x -> struct('s' AS kind, x.suffix AS name, x.n AS n)))"""))
    alone = links.filter("size(seen) = 1").select("at", "best", F.inline("names"))
    several = links.filter("size(seen) > 1").select("at", "best", F.inline("names")).groupBy("at", "best", "kind", "name").agg(F.sum("n").alias("n"))
    links = alone.unionByName(several)
    votes = links.groupBy("kind", "name", "best").agg(F.count("*").alias("n"))
    by_suffix, n_suffixes = np.zeros(n), votes.filter("kind = 's'").select("name").distinct().count()
    for best, k in votes.filter("kind = 's'").groupBy("best").agg(F.sum("n")).collect():
        by_suffix[best] = k
    counts = votes.groupBy("kind", "name").agg(F.collect_list(F.struct("best", "n")).alias("c"))
    found = links.select("at", "kind", "name", "n").join(counts, ["kind", "name"])
    one = F.struct("name", "n", "c")
    found = found.groupBy("at").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, one))).alias(k) for k in "hds"])
    joined = scored.select("at", "key", "declared", F.transform("seen", lambda x: F.struct(x["declared"].alias("declared"), x["n"].alias("n"))).alias("said"), "best", "scores") \
        .join(found, "at", "left").drop("at")

    def owners(lists: pa.ListArray) -> np.ndarray:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(lists)), sizes)

    def told_by(c: dict, name: str, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts by language of each name of each row, without the row's own vote; the rows and numbers of pages."""
        row, flat = owners(c[name]), c[name].flatten()
        lists = flat.field("c") if len(flat) else pa.array([], pa.list_(pa.struct([("best", pa.int32()), ("n", pa.int64())])))
        cells = lists.flatten()
        out = np.zeros((len(row), n))
        if len(row):
            out[owners(lists), cells.field("best").to_numpy(zero_copy_only=False)] = cells.field("n").to_numpy(zero_copy_only=False)
            out = np.maximum(out - own[row], 0)
        return out, row, flat.field("n").to_numpy(zero_copy_only=False) if len(row) else np.zeros(0)

    def shared_weight(total: np.ndarray, row: np.ndarray, weight: np.ndarray, logs: np.ndarray) -> None:
        """Add to each row the mean of its logs, by weight."""
        sums = np.bincount(row, weight, len(total))
        np.add.at(total, row, logs * (weight / sums[row])[:, None])

    def few(c: dict) -> dict:
        size = len(c["best"])
        best = c["best"].to_numpy(zero_copy_only=False)
        own = (best[:, None] == np.arange(n)).astype(float)
        level = np.maximum(everywhere - own, 0) + 1.0
        level /= level.sum(axis=1, keepdims=True)
        for name in ("d", "h"):
            votes_of, row, _ = told_by(c, name, own)
            seen = np.zeros((size, n))
            np.add.at(seen, row, votes_of)
            level = (seen + INHERITED * level) / (seen.sum(axis=1, keepdims=True) + INHERITED)
        total = np.log(level) + TEMPER / GRAIN * c["scores"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        row, values = owners(c["said"]), c["said"].flatten()
        if len(row):
            words, weight = values.field("declared"), values.field("n").to_numpy(zero_copy_only=False).astype(float)
            there = words.is_valid().to_numpy(zero_copy_only=False)
            code = np.array([named.get(d, n) for d in words.drop_null().to_pylist()], dtype=np.int64)
            shared_weight(total, row[there], weight[there], log_declared[code])
        votes_of, row, weight = told_by(c, "s", own)
        shared_weight(total, row, weight, np.log((votes_of + UNSEEN) / (by_suffix + UNSEEN * max(1, n_suffixes))))
        total -= total.max(axis=1, keepdims=True)
        post = np.exp(total)
        post /= post.sum(axis=1, keepdims=True)
        first = post.argmax(axis=1)
        sure = post[np.arange(size), first]
        ok = best >= 0
        return {"key": c["key"], "language": pa.array([languages[i] if o else UNKNOWN for i, o in zip(first, ok)], pa.string()),
                "posterior": pa.array(np.where(ok, sure, 0.0)), "text_language": pa.array([languages[i] if i >= 0 else UNKNOWN for i in best], pa.string()),
                "declared": c["declared"], "kept": pa.array(ok & (sure >= LEAST_POSTERIOR))}

    def step(c: dict) -> dict:
        size, at_once = len(c["best"]), max(1, STEP_CELLS // n)
        parts = [few({k: v.slice(i, at_once) for k, v in c.items()}) for i in range(0, max(1, size), at_once)]
        return {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]}

    return arrow_map(joined, f"key {kind}, language string, posterior double, text_language string, declared string, kept boolean", step)


def page_evidence(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, markup, host and suffix of the first page that shows a document, and `seen`, what all of them say.

    The last number of a page's path is the doc_id; pages without such a number or address are no evidence. markup is
    the lang of the first <html tag outside comments, wherever it stands. The first page is that with the smallest page_id;
    seen has each distinct markup, suffix and host with the number of pages. With `known` (doc_id) only its documents
    are collected: a path may end in any number.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    tag = F.regexp_extract(F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", ""), r"(?i)<html\b[^>]*", 0)
    shown = pages.select(
        "page_id", F.expr("try_cast(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/([0-9]+)(?:[.][a-z]+)?/?$', 1), '') as bigint)").alias("doc_id"),
        F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1).alias("markup"), F.lower(host).alias("host"))
    shown = shown.filter((path != "") & F.col("doc_id").isNotNull())
    if known is not None:
        shown = shown.join(known, "doc_id", "left_semi")
    suffix = F.regexp_extract("host", r"\.([a-z]{2,})$", 1)
    shown = shown.select("page_id", "doc_id", *[F.when(c != "", c).alias(name) for name, c in (("markup", F.col("markup")), ("suffix", suffix), ("host", F.col("host")))])
    what = ("markup", "suffix", "host")
    each = shown.groupBy("doc_id", *what).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    every = each.groupBy("doc_id").agg(F.min(F.struct("page_id", *what)).alias("p"), F.collect_list(F.struct(F.col("markup").alias("declared"), "suffix", "host", "n")).alias("seen"))
    return every.select("doc_id", "p.markup", "p.host", "p.suffix", "seen")


def _seen(declared: Column, suffix: Column, host: Column) -> Column:
    return F.array(F.struct(declared.cast("string").alias("declared"), suffix.cast("string").alias("suffix"), host.cast("string").alias("host"), F.lit(1).cast("bigint").alias("n")))


def identify(df: DataFrame, text: Column, declared: Column, suffix: Column, host: Column, key: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """`score` and `fuse` where a row brings all its evidence itself."""
    carry = {"key": key, "declared": primary(declared), "suffix": suffix.cast("string"), "host": host.cast("string")}
    scored = score(df, text, declared, carry, train_rows)
    return fuse(scored, F.col("declared"), _seen(F.col("declared"), F.col("suffix"), F.col("host")), F.col("key"))


def identify_documents(docs: DataFrame, pages: DataFrame, key: Column) -> DataFrame:
    """`fuse` over documents (doc_id, text, lang, source): markup, hosts and suffixes come from all pages that show a document.

    Where a page has no markup or host, and without a page, lang and source stand in; the column `declared` is the first
    page's. Pages meet scores, never texts.
    """
    scored = score(docs, F.col("text"), F.col("lang"), {"key": key, "doc_id": F.col("doc_id").cast("bigint"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})
    scored.rows = scored.rows.join(page_evidence(pages, scored.rows.select("doc_id").distinct()), "doc_id", "left")
    lang, source = F.col("lang"), F.col("source")
    of_pages = F.transform("seen", lambda x: F.struct(F.coalesce(x["declared"], lang).alias("declared"), x["suffix"].alias("suffix"), F.coalesce(x["host"], source).alias("host"), x["n"].alias("n")))
    return fuse(scored, F.coalesce("markup", "lang"), F.coalesce(of_pages, _seen(lang, F.lit(None), source)), F.col("key"))


def keep_identified(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source and others), all columns, whose language is told well enough.

    Verdicts go by 128 bits of the four columns; the few rejected are joined away, so texts stay in place.
    """
    row = row_hash(*map(F.col, ("doc_id", "text", "lang", "source")))
    found, _ = written(identify_documents(docs, pages, row).select(F.col("key").alias("row"), "kept"), "verdicts")
    all_columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")
    named = docs.select(row.alias("row"), all_columns)
    return without_rows(named, found.filter(~F.col("kept")), found.filter("kept")).select("all.*")
