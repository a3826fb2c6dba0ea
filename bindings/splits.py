"""Folds and sets."""

from pyspark.sql import functions as F

from airgrid.operators import splits as S
from airgrid.operators.sets import stack
from bindings.registry import query

_RANKED = "(SELECT *, percent_rank() OVER (ORDER BY date) AS r FROM {labels_grid})"


def _cuts(cuts, last):
    return "CASE " + " ".join(f"WHEN r < {c}e0 THEN {v}" for c, v in cuts) + f" ELSE {last} END"


@query("split_six_folds", "SELECT label_id, " + _cuts(
    list(zip(["0.12", "0.17", "0.28", "0.33", "0.45", "0.50", "0.62", "0.67", "0.78", "0.83", "0.95"], range(11))), 11)
    + f" AS foldNumber FROM {_RANKED}")
def _(t):
    return S.time_split(t.labels_grid, "date", S.six_folds, "foldNumber").select("label_id", "foldNumber")


@query("split_two_way", f"""
       SELECT label_id, CAST(r >= 0.67e0 AS INT) AS fold67, CAST(r >= 0.8e0 AS INT) AS fold80 FROM {_RANKED}""")
def _(t):
    ranked = S.time_split(t.labels_grid, "date", lambda r: S.two_way(r, 0.67), "fold67", keep_rank=True)
    return ranked.withColumn("fold80", S.two_way(F.col("rank"), 0.8)).select("label_id", "fold67", "fold80")


@query("split_named", "SELECT label_id, " + _cuts([("0.8", "'train'"), ("0.9", "'valid'")], "'test'")
       + f' AS "Set" FROM {_RANKED}')
def _(t):
    return S.time_split(t.labels_grid, "date", S.named_split).select("label_id", "Set")


@query("split_nested", "SELECT label_id, CASE WHEN r < 0.4e0 THEN 'train' WHEN r < 0.45e0 THEN 'valid' WHEN r <= 0.5e0 THEN 'test' END AS Set_1, "
       + _cuts([("0.8", "'train'"), ("0.9", "'valid'")], "'test'") + f" AS Set_2 FROM {_RANKED}")
def _(t):
    return S.nested_time_split(t.labels_grid, "date").select("label_id", "Set_1", "Set_2")


@query("split_outer_edge", "SELECT label_id, " + _cuts(
    [("0.08", "'test'"), ("0.16", "'valid'"), ("0.9", "'train'"), ("0.95", "'valid'")], "'test'") + f' AS "Set" FROM {_RANKED}')
def _(t):
    return S.time_split(t.labels_grid, "date", S.outer_edge_split).select("label_id", "Set")


_TENTHS = [(f"{(10 * i + p) / 100:.2f}", f"'{n}'") for i in range(10) for p, n in ((8, "train"), (9, "valid"), (10, "test"))]


@query("split_interleaved", "SELECT label_id, " + _cuts(_TENTHS[:-1], "'test'") + f' AS "Set" FROM {_RANKED}')
def _(t):
    return S.time_split(t.labels_grid, "date", S.interleaved_split).select("label_id", "Set")


def _hash(key):
    return f"CAST(concat('0x', substr(md5(concat({key}, '|42')), 1, 8)) AS BIGINT) / 4294967296e0"


def _sets(key):
    return f"(CASE WHEN {_hash(key)} < 0.8e0 THEN 'train' WHEN {_hash(key)} < 0.9e0 THEN 'valid' ELSE 'test' END)"


@query("split_random_days", f"""SELECT label_id, {_sets('CAST(date AS VARCHAR)')} AS "Set" FROM {{labels_grid}}""")
def _(t):
    return t.labels_grid.select("label_id", S.random_split(F.col("date")).alias("Set"))


@query("split_random_rows", f"""SELECT label_id, {_sets('CAST(label_id AS VARCHAR)')} AS "Set" FROM {{labels_grid}}""")
def _(t):
    return t.labels_grid.select("label_id", S.random_split(F.col("label_id")).alias("Set"))


@query("split_calendar", """
       SELECT label_id, CASE WHEN date < DATE '2000-04-01' THEN 'train' ELSE 'test' END AS "Set" FROM {labels_grid}""")
def _(t):
    return t.labels_grid.select("label_id", S.calendar_split(F.col("date"), "2000-04-01").alias("Set"))


@query("split_assignment_join", f"""
       SELECT label_id, s."Set" FROM {{labels_grid}} LEFT JOIN (
         SELECT date, {_sets('CAST(date AS VARCHAR)')} AS "Set" FROM (SELECT DISTINCT date FROM {{labels_grid}})) s USING (date)""")
def _(t):
    days = t.labels_grid.select("date").distinct().withColumn("Set", S.random_split(F.col("date")))
    return t.labels_grid.join(days, "date", "left").select("label_id", "Set")


@query("split_reunion", "SELECT label_id FROM {labels_grid}")
def _(t):
    parts = t.labels_grid.select("label_id", S.random_split(F.col("date")).alias("Set"))
    return stack(*[parts.where(F.col("Set") == n).select("label_id") for n in ("train", "valid", "test")])
