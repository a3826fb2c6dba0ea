import re

import duckdb
import pytest

from airgrid.llm import quality_rules as Q
from airgrid.llm.registry import ORACLES, QUERIES
from tests.llm.cases import EDGES, FOLDER, edges, exact, words


UNSPACED = "[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), Q.UNSPACED) + "]"
STOPPED = set(" ".join(Q.STOP_WORDS.values()).split())


def brute(text, lang=None):
    w, t = words(text), text or ""
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    at = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    counts = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in Q.SYMBOLS for c in t), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(at),
                  n_lines=len(lines), n_marks=sum(c in "!?" for c in t), n_upper=sum("A" <= c <= "Z" for c in t), n_stop_words=sum(x.lower() in STOPPED for x in w))
    counts["n_spaced"] = sum(len(re.sub(UNSPACED, "", x)) for x in w)
    listed = bool(lang) and re.split("[-_]", lang)[0].lower() in Q.STOP_WORDS
    failed = len(w) < 10 or 100 * len(at) > 20 * len(w)
    good = all((r.low is None or counts[r.of] + r.slack >= r.low * counts[r.per]) and (r.high is None or counts[r.of] - r.slack <= r.high * counts[r.per]) for r in Q.RULES if r.name != "stop_words" or listed)
    return (*counts.values(), listed, failed, not failed and good)


@pytest.mark.parametrize("extra", [False, True])
def test_counts_and_verdicts(spark, extra):
    got = Q.quality_columns(edges(spark, extra), keep=["doc_id"]).collect()
    assert exact(got) == exact((k, *brute(t, g)) for k, t, g, _ in EDGES)


def test_query_beside_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    theirs = con.execute(ORACLES["op2_quality_rules"])
    names = [d[0] for d in theirs.description]
    ours = QUERIES["op2_quality_rules"](spark, FOLDER).select(names).collect()
    assert exact(ours) == exact(theirs.fetchall())


def test_plan_has_neither_python_nor_shuffle(spark):
    plan = QUERIES["op2_quality_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rows_kept_have_all_columns(spark):
    docs = edges(spark, True)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(k for k, t, g, _ in EDGES if k and brute(t, g)[-1])


def test_labels_agree(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    found = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, FOLDER).collect()}
    judged = [k for k in labels if not found[k].base_failed]
    assert sum(found[k].kept == bool(labels[k]) for k in judged) >= 0.97 * len(judged)
    assert all(found[k].kept for k in judged if labels[k])


def test_no_rows(spark):
    assert Q.quality_columns(edges(spark).limit(0)).count() == 0


RUSSIAN = ("Утром река поднялась выше обычного уровня, поэтому жители нижних улиц перенесли вещи наверх. Днём приехали инженеры, осмотрели старую плотину и решили "
           "открыть два затвора. Вечером вода начала медленно уходить, но дорогу через мост пока закрыли. Учителя перевели занятия в школу на холме, где хватило места "
           "всем детям. Через неделю деревня вернулась к обычной жизни, хотя поля ещё долго стояли мокрыми.")
CZECH = ("Ráno řeka vystoupila výše než obvykle, proto obyvatelé dolních ulic odnesli věci nahoru. Během dne přijeli inženýři, prohlédli starou hráz a rozhodli otevřít dvě "
         "stavidla. Večer voda začala pomalu klesat, ale cesta přes most zůstala zavřená. Učitelé přesunuli vyučování do školy nad vsí, kde bylo dost místa pro všechny děti. "
         "Za týden ves žila jako dřív, jen pole byla ještě dlouho mokrá a těžká.")
JAPANESE = " ".join(["朝になると川の水位がいつもより高くなったので低い通りの住民は荷物を上の階へ運んだ。", "昼には技師たちが到着し古い堤防を調べて二つの水門を開けることに決めた。", "夕方には水がゆっくり引き始めたが橋の道はまだ閉ざされていた。"] * 19)


@pytest.mark.parametrize("lang, text", [("ru", RUSSIAN), ("cs-CZ", CZECH), ("ja", JAPANESE), (None, RUSSIAN), ("zz", CZECH)])
def test_clean_texts_of_other_languages_stay(spark, lang, text):
    text = text if lang == "ja" else text + " " + " ".join(reversed(text.split()))
    df = spark.createDataFrame([(1, text, lang)], "doc_id bigint, text string, lang string")
    row = Q.quality_columns(df).first()
    assert row.n_words >= 55 and row.kept == (not row.base_failed)
    assert not row.base_failed or lang == "ja"
    assert Q.keep_good(df.drop("lang")).count() == (not row.base_failed)


def test_words_of_a_script_without_spaces_may_be_long(spark):
    words = ["".join(chr(0x4E00 + (k * 31 + i * 7) % 5000) for i in range(30)) for k in range(55)]
    df = spark.createDataFrame([(1, " ".join(words), "ja"), (2, " ".join("x" * 30 + str(k) for k in range(55)), "ja")], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.kept for r in Q.quality_columns(df).collect()} == {1: True, 2: False}
