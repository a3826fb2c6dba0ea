"""Quality rules: a threshold table compiled into one projection of counts and ratios, all of it Spark's own functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import SPACE, words_of

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent words by language, lower case. The rule on them binds for texts that declare one of these languages.
STOP_WORDS = {
    "en": "a and are as at be by for from have in is it of on or that the this to was were with",
    "fr": "au avec dans de des du elle en est et la le les ne pas pour qui que sur un une",
    "de": "auf das dem den der des die ein eine für im ist mit nicht sich und von zu",
    "es": "como con de del el en es la las lo los no para por que se su un una y",
}
#: Characters of scripts that write without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han), as ranges.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"


@dataclass(frozen=True)
class Rule:
    """low * per - slack <= of <= high * per + slack; a bound that is None does not bind. Slack spares short texts.

    `where` names a column of conditions: the rule binds only where it holds.
    """

    name: str
    of: str
    per: str
    low: float | None = None
    high: float | None = None
    slack: int = 0
    where: str | None = None


#: Ratios a clean text keeps to.
RULES = (
    Rule("short_words", "word_chars", "n_words", low=2.0),
    Rule("long_words", "n_spaced", "n_words", high=20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("marks_per_word", "n_marks", "n_words", high=0.25),
    Rule("upper_case", "n_upper", "word_chars", high=0.4),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, slack=1, where="listed"),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.3, slack=2),
)


def _count_of(text: Column, characters: str) -> Column:
    """How many characters belong to a regular expression's class; runs of others go at one stroke."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _verdict(rules: tuple[Rule, ...]) -> Column:
    """All rules as one condition; counts are compared as whole numbers times a bound, without division."""
    holds = F.lit(True)
    for r in rules:
        of, per, free = F.col(r.of).cast("double"), F.col(r.per).cast("double"), ~F.col(r.where) if r.where else F.lit(False)
        if r.low is not None:
            holds = holds & (free | (of + r.slack >= per * r.low))
        if r.high is not None:
            holds = holds & (free | (of - r.slack <= per * r.high))
    return holds


def _listed(lang: Column, stop_words: dict[str, str]) -> Column:
    """Whether a language tag's primary subtag has a list; never NULL."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(lang.cast("string")), r"^([A-Za-z]{2,3})(?:$|[-_])", 1)).isin(*stop_words), F.lit(False))


def quality_columns(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: dict[str, str] = STOP_WORDS,
                    keep: tuple[str, ...] | list[str] | None = None, lang: str = "lang") -> DataFrame:
    """Counts, base_failed and kept beside the columns `keep` (default: all of df whose names do not clash).

    Counts are long: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in 5-word windows that stand
    twice or more in the text), n_lines (lines with a word), n_marks (exclamation and question marks), n_upper (A-Z),
    n_stop_words (words of any list), n_spaced (code points in words, those of scripts without spaces left out). listed: the
    declared language `lang` has a list of stop words; NULL, other and unknown ones have none, nor has a table without
    that column. base_failed: under 10 words, or more than 20 % repeated words. kept: neither base_failed nor any rule
    broken. NULL or empty text has zero counts, fails the base and is not kept. Rows stand alone: ties and repeated
    rows each get their own verdict, no shuffle. Windows are compared by 64-bit hashes within one text; the sort behind
    it keeps long texts at n log n. Columns of df that bear a result's name are left out.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_stop_words",
               "n_spaced", "listed", "base_failed", "kept"]
    names = [c for c in (df.columns if keep is None else keep) if c not in results]
    own = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)]
    held = [*[f"in_{i}" for i in range(len(names))], "listed"]
    own.append((_listed(F.col(f"`{lang}`"), stop_words) if lang in df.columns else F.lit(False)).alias("listed"))
    stopped = list(dict.fromkeys(" ".join(stop_words.values()).split()))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = df.select(*own, t.alias("t"), words_of(F.col(f"`{text}`")).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.select(*held, "t", "w", "lines", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    h = F.col("h")
    step = step.select(*held, "t", "w", "lines", F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])), 1,
                                                         F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))).alias("win"))
    win = F.col("win")
    step = step.select(*held, "t", "w", "lines", F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(
        F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"))
    s = F.col("s")
    again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"])))
    step = step.select(*held, "t", "w", "lines", F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)))),
                          F.lit(0).cast("bigint"), lambda total, x: total + x)
    counts = {
        "n_words": F.size("w"), "word_chars": F.length(F.regexp_replace("t", SPACE, "")), "n_symbols": _count_of(F.col("t"), SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": covered, "n_lines": F.size("lines"),
        "n_marks": _count_of(F.col("t"), "!?"), "n_upper": _count_of(F.col("t"), "A-Z"),
        "n_stop_words": F.size(F.filter("w", lambda x: F.lower(x).isin(*stopped))),
    }
    counts["n_spaced"] = counts["word_chars"] - _count_of(F.col("t"), UNSPACED)

    # a filter on the verdict must stay above the counts: pushed below, it would repeat their expressions many times over
    out = step.select(*held, *[c.cast("bigint").alias(n) for n, c in counts.items()], F.monotonically_increasing_id().alias("row_no"))
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    failed = ((F.col("n_words") < MIN_WORDS) | repeats) & (F.col("row_no") >= 0)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & _verdict(rules))
    return out.select(*[F.col(a).alias(b) for a, b in zip(held, names)], *results)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of `docs` that the rules keep, with all its columns."""
    declared = F.col(f"`{lang}`") if lang in docs.columns else F.lit(None).cast("string")
    marked = quality_columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t0"), declared.alias("l0")), "t0",
                             keep=["row"], lang="l0")
    return marked.filter("kept").select("row.*")


def oracle() -> str:
    """DuckDB text for the query over `documents`."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(" ".join(STOP_WORDS.values()).split()))
    tags = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lower(regexp_extract(trim(lang), '^([A-Za-z]{{2,3}})(?:$|[-_])', 1)) IN ({tags}), false) AS listed,
                  row_number() OVER () AS row FROM documents),
p AS (SELECT doc_id, t, row, listed, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT row, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM p)),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
c AS (SELECT row, sum(least({WINDOW}, coalesce(after - i, {WINDOW})))::BIGINT AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS after FROM r) GROUP BY row),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             (length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) - length(regexp_replace(t, '[^{UNSPACED}]', '', 'g')))::BIGINT AS n_spaced, listed
      FROM p LEFT JOIN c USING (row)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q)
SELECT *, NOT base_failed AND {" AND ".join(_sql(r) for r in RULES)} AS kept FROM b"""


def _sql(r: Rule) -> str:
    bounds = [f"{r.of} + {r.slack} >= {r.per} * {r.low!r}::DOUBLE"] * (r.low is not None) + [f"{r.of} - {r.slack} <= {r.per} * {r.high!r}::DOUBLE"] * (r.high is not None)
    return f"({f'NOT {r.where} OR ' * bool(r.where)}{' AND '.join(bounds)})"
