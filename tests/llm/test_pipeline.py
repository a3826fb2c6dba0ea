import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from airgrid.llm import language_id, registry
from tests.llm.cases import FOLDER, edges
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import brute as quality
from tests.llm.test_simhash import fingerprint, roots
from tests.llm.test_substring import brute as repeats


def test_run_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    verdict = language_id.identify_documents(docs, spark.read.parquet(f"{FOLDER}/pages.parquet"), F.col("doc_id"))
    told = {r.key for r in verdict.collect() if r.kept}
    rows = [(k, t) for k, t in rows if k in told and quality(t)[-1]]
    root = roots([fingerprint(t) for _, t in rows])
    rows = [x for i, x in enumerate(rows) if root[i] == i]
    rows = [(k, kept if gone else t) for (k, t), (_, _, gone, kept) in zip(rows, repeats(rows))]
    n, bound = check(C.run(spark, FOLDER).collect(), rows, C.CAPACITY)
    assert n <= bound + 1 and len(rows) > 50


def test_stages_keep_columns_and_bear_any_rows(spark):
    for start in (edges(spark, True).withColumn("n_chars", F.length("text").cast("bigint")), edges(spark).limit(0)):
        docs = start
        for name, stage in C.STAGES[:-1]:
            after = stage(spark, docs, FOLDER)
            assert after.columns == docs.columns, name
            docs = C.written(after, name)[0]
        packed = C.STAGES[-1][1](spark, docs, FOLDER)
        assert packed.count() >= docs.count()


def test_all_operators_are_registered():
    assert [n for n in registry.QUERIES if n.startswith("op")] == list(registry.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
    assert len(C.STAGES) == 5
