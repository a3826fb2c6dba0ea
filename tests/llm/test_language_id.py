import math
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from airgrid.llm import language_id as L
from airgrid.llm.registry import QUERIES
from tests.llm.cases import FOLDER, edges

SCHEMA = "k bigint, text string, declared string, suffix string, host string"


def features(text):
    raw = [b if 97 <= b <= 122 or b >= 128 else 0 for b in (" " + text.lower() + " ").encode()] if text else []
    return [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 17 for a, b, c in zip(raw, raw[1:], raw[2:]) if b]


def tag(declared):
    head = (declared or "").strip().replace("_", "-").split("-")[0].lower()
    return head if 2 <= len(head) <= 3 and head.isascii() and head.isalpha() else None


def brute(rows):
    """The same fusion, row by row with dictionaries; the sample is all rows."""
    labelled = Counter(tag(d) for _, _, d, _, _ in rows if tag(d))
    names = sorted(x for x, n in labelled.items() if n >= L.LEAST_SHARE * sum(labelled.values()))
    counts = {n: Counter() for n in names}
    for _, t, d, _, _ in rows:
        if tag(d) in counts:
            counts[tag(d)].update(features(t))
    log = {n: {f: round(L.GRAIN * math.log((counts[n][f] + 0.5) / (sum(counts[n].values()) + 0.5 * L.FEATURES))) for _, t, *_ in rows for f in features(t)} for n in names}
    text = [[sum(log[n][f] for f in features(t)) for n in names] if features(t) else None for _, t, *_ in rows]
    best = [None if s is None else s.index(max(s)) for s in text]
    votes = {"all": Counter()}
    for (_, _, d, s, h), b in zip(rows, best):
        if b is not None:
            votes["all"][b] += 1
            if h is not None:
                for key in (("h", h.lower()), ("d", ".".join(h.lower().split(".")[-2:])), *([("s", s.lower())] if s is not None else [])):
                    votes.setdefault(key, Counter())[b] += 1
            if tag(d):
                votes.setdefault(("said", tag(d) if tag(d) in names else ""), Counter())[b] += 1
    suffixes = [k for k in votes if k[0] == "s"]
    for (k, _, d, s, h), b, scores in zip(rows, best, text):
        if b is None:
            yield k, "und", 0.0
            continue
        total = []
        own = lambda i: i == b
        n_all = sum(votes["all"].values()) - 1 + len(names)
        prior = [(votes["all"][i] - own(i) + 1) / n_all for i in range(len(names))]
        if h is not None:
            for key in (("d", ".".join(h.lower().split(".")[-2:])), ("h", h.lower())):
                seen = votes[key]
                n = sum(seen.values()) - 1
                prior = [(seen[i] - own(i) + L.INHERITED * prior[i]) / (n + L.INHERITED) for i in range(len(names))]
        for i in range(len(names)):
            x = math.log(prior[i]) + L.TEMPER / L.GRAIN * scores[i]
            if tag(d):
                said = [votes.get(("said", v), Counter())[i] + L.UNSEEN for v in [*names, ""]]
                x += math.log(said[names.index(tag(d)) if tag(d) in names else len(names)] / sum(said))
            if s is not None and h is not None and ("s", s.lower()) in votes:
                x += math.log((votes[("s", s.lower())][i] - own(i) + L.UNSEEN) / (sum(votes[key][i] for key in suffixes) + L.UNSEEN * max(1, len(suffixes))))
            total.append(x)
        top = max(total)
        weights = [math.exp(x - top) for x in total]
        yield k, names[weights.index(max(weights))], max(weights) / sum(weights)


def small_table():
    rng = random.Random(9)
    known = {"en": "the of and to in that is with was for", "fr": "le la les des une dans est que pour avec", "de": "der die das und nicht mit ein ist auf für"}
    rows = []
    for i in range(150):
        lang = rng.choice(list(known))
        said = rng.choice([lang, lang, lang.upper() + "-XX", None, "zz", "not a tag", rng.choice(list(known))])
        host = rng.choice([f"www.{lang}.org", f"a.{lang}.org", "hot.com", "hot.com", None, f"h{i}.net"])
        rows.append((i, " ".join(rng.choices(known[lang].split(), k=rng.randint(0, 6))), said, None if host is None else host.split(".")[-1], host))
    return rows + [(None, None, None, None, None), (3, "123 %%", "en", "com", "hot.com"), (3, "the the", "en", "com", "hot.com"), (3, "the the", "en", "com", "hot.com")]


def test_fusion_against_brute_force(spark):
    rows = small_table()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("best", F.lit("clash")).withColumn("scores", F.lit("clash"))
    got = L.identify(df, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"), F.col("k")).collect()
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    ours, theirs = sorted(((r.key, r.language, r.posterior) for r in got), key=order), sorted(brute(rows), key=order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6, (a, b)
    assert all(r.kept == (r.language != "und" and r.posterior >= L.LEAST_POSTERIOR) for r in got)


def test_no_rows_and_no_labels(spark):
    df = spark.createDataFrame(small_table(), SCHEMA)
    ask = lambda d: L.identify(d, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"), F.col("k"))
    assert ask(df.limit(0)).count() == 0
    blind = ask(df.withColumn("declared", F.lit(None).cast("string"))).collect()
    assert {r.language for r in blind} == {"und"} and sum(r.kept for r in blind) == sum(bool(features(t)) for _, t, *_ in small_table())


def test_held_out_accuracy(spark):
    """Texts that the model was not fitted on, with no other evidence."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) > 40")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = L.fit(docs.filter(~held).selectExpr("text", "lang as declared"))
    rows = docs.filter(held).select("text", "lang").collect()
    scores, _ = model.scores([r.text for r in rows])
    hits = sum(model.languages[i] == r.lang for i, r in zip(scores.argmax(axis=1), rows))
    assert len(rows) > 20 and hits >= 0.9 * len(rows)


def test_query(spark):
    found = QUERIES["op1_language_id"](spark, FOLDER).collect()
    declared = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    assert sorted(r.doc_id for r in found) == sorted(declared)
    assert sum(r.language == declared[r.doc_id] for r in found) >= 0.98 * len(found)
    assert all(r.kept for r in found)


def test_page_evidence(spark):
    pages = spark.createDataFrame([
        (2, "https://www.A.org/fr/12?x=1", '<!DOCTYPE html><html class="x" lang="fr-FR"><p>'), (1, "http://b.com/12.html", "<html lang=en>"), (3, "http://b.com/x", "<html lang=en>"),
        (4, None, None), (5, "http://10.0.0.1:80/en/7/", "<p lang='de'>"), (6, "http://c.net/99999999999999999999", "")], "page_id bigint, url string, html string")
    assert sorted(tuple(r) for r in L.page_evidence(pages).select("doc_id", "markup", "host", "suffix").collect()) == [(7, None, "10.0.0.1", None), (12, "en", "b.com", "com")]


def test_rejected_rows_go(spark):
    docs = edges(spark, True)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    kept = L.keep_identified(docs, pages)
    assert kept.columns == docs.columns
    verdicts = L.identify_documents(docs, pages, F.struct("doc_id", "text")).filter("kept").count()
    assert kept.count() == verdicts > 0
    assert all(r.text and r.text.strip() for r in kept.collect())


def test_rare_languages_are_told(spark):
    """A language with less than 0.2 % of the rows, and one beyond the 64 most frequent."""
    words = {"en": "the of and to in that is with was for", "cy": "yr ddraig goch rhwng llyn mynydd gwyrdd cymru ysgol"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words["en"].split(), k=12)), "en", None, None) for i in range(1200)]
    rows += [(2000 + i, " ".join(rng.choices(words["cy"].split(), k=12)), "cy", None, None) for i in range(2)]
    many = [f"{a}{b}" for a in "qxzjkw" for b in "qxzjkwvbfhm"]
    made = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(8)] for x in many}
    rows += [(3000 + 20 * k + i, " ".join(rng.choices(made[x], k=9)), x, None, None) for k, x in enumerate(many) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    for train_rows in (L.TRAIN_ROWS, 700):
        found = {r.key: (r.language, r.kept) for r in L.identify(df, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"), F.col("k"), train_rows).collect()}
        assert [found[k] for k, *_ in rows] == [(d, True) for _, _, d, _, _ in rows]


def test_all_pages_of_a_document_count(spark):
    words = {"en": "the of and to in that is with was for", "fr": "le la les des une dans est que pour avec"}
    rng = random.Random(4)
    docs, pages = [], []
    for i in range(200):
        lang = "fr" if i % 2 else "en"
        docs.append((i, " ".join(rng.choices(words[lang].split(), k=8)), lang, "s"))
        pages.append((10 * i + 1, f"http://www.{lang}.org/{i}", "<!-- <html lang=xx> -->" + " " * 3000 + f"<html class=x lang={lang}>"))
    # no word tells; the first page says nothing of use, the two others do
    docs.append((500, "zzz", None, None))
    pages += [(1, "http://nowhere.net/500", "<html>"), (8001, "http://www.fr.org/500", "<html lang=fr>"), (8002, "http://www.fr.org/x/500", "<html lang=fr>")]
    docs, pages = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(pages, "page_id bigint, url string, html string")
    seen = {r.doc_id: r for r in L.page_evidence(pages).collect()}
    assert (seen[3].markup, seen[4].markup) == ("fr", "en")
    assert sorted((x.declared or "", x.host, x.suffix, x.n) for x in seen[500].seen) == [("", "nowhere.net", "net", 1), ("fr", "www.fr.org", "org", 2)]
    found = {r.key: r for r in L.identify_documents(docs, pages, F.col("doc_id")).collect()}
    assert len(found) == 201 and found[500].language == "fr" and found[500].posterior > 0.9
    first = {r.key: r for r in L.identify_documents(docs, pages.filter("page_id < 8000"), F.col("doc_id")).collect()}
    assert first[500].posterior < 0.9


def test_pages_of_other_numbers_are_not_collected(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/{i % 2}", "<html lang=fr>") for i in range(50)], "page_id bigint, url string, html string")
    known = spark.createDataFrame([(1,), (7,)], "doc_id bigint")
    assert [(r.doc_id, len(r.seen)) for r in L.page_evidence(pages, known).collect()] == [(1, 25)]


def test_rows_are_named_by_all_their_columns(spark):
    from airgrid.llm.common import row_hash

    rows = [(None, None), (None, ""), (1, None), (1, ""), (1, "a"), (None, "a")]
    df = spark.createDataFrame(rows * 2, "k bigint, t string")
    assert df.select(row_hash(F.col("k"), F.col("t")).alias("r")).distinct().count() == len(rows)
