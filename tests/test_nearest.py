"""The k nearest rows: the same as the SELECT planned as it stands, without looking at pairs one by one."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rivulet.operators import nearest as op
from rivulet.plans import dialect

SQL = """SELECT a, b, d, n FROM (SELECT q.id AS a, e.id AS b, array_distance(q.v, e.v) AS d, row_number() OVER (PARTITION BY q.id ORDER BY array_distance(q.v, e.v), e.id) AS n
    FROM t q JOIN u e ON q.id % 3 = 0 AND q.id <> e.id) x WHERE n <= 4"""


def both(spark, sql=SQL, **tables):
    """Rows by the blocks and by the plan as it stands, and the plan of the first."""
    got = dialect.query(spark, sql, **tables)
    with dialect.exact_names(spark):
        want = dialect.integer_division(dialect.translate(sql), spark.sql)
    plain = lambda df: sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()), key=str)
    assert got.dtypes == want.dtypes
    return plain(got), plain(want), got._jdf.queryExecution().optimizedPlan().toString()


def table(spark, rows, kind="array<float>", ids="bigint"):
    return spark.createDataFrame(rows, f"id {ids}, v {kind}")


def test_no_lambda_for_each_pair(spark):
    rng = np.random.default_rng(3)
    t = table(spark, [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)])
    got, want, plan = both(spark, t=t, u=t)
    assert got == want and len(got) == 400
    assert "zip_with" not in plan and "aggregate(" not in plan


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_odd_vectors(spark, kind):
    """Null vectors and elements, NaN, infinities, numbers whose squares overflow or vanish, copies, ids that come twice or are null."""
    nan, inf = float("nan"), float("inf")
    odd = [None, [None, 1.0], [nan, 1.0], [inf, 0.0], [-inf, inf], [1e19, 1e19], [1.00001e19, 1e19], [1e-30, 0.0], [0.0, -0.0], [1.0, 1.0], [1.0, 1.0], [1000000.0, 1000001.0], [1000000.0, 1000001.5]]
    odd += [] if kind == "array<float>" else [[1.2e154, 0.0], [0.5e154, 0.0], [1e200, 1e200], [1e200, 1.01e200], [1e-170, 1e-170]]
    rows = [(i % 40, v) for i, v in enumerate(odd * 4)] + [(None, [1.0, 1.0])]
    t = table(spark, rows, kind)
    got, want, _ = both(spark, t=t, u=t)
    assert got == want and got
    own = table(spark, [(0, v) for v in odd], kind)
    got, want, _ = both(spark, t=own, u=t)
    assert got == want


def test_ties_and_blocks(spark, monkeypatch):
    """Points of a grid, most of them many times, in small blocks: rows as near are told apart by their ids."""
    for name, value in (("BLOCK_ROWS", 50), ("QUERY_ROWS", 20)):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(5)
    t = table(spark, [(int(i), [float(x) for x in rng.integers(0, 3, size=3)]) for i in rng.permutation(700)], "array<double>", "int").repartition(5)
    u = table(spark, [(int(i), [float(x) for x in rng.integers(0, 3, size=3)]) for i in rng.permutation(900)])
    for left, right in ((t, t), (t, u), (u, t), (t.where("id < 0"), u), (t, u.where("id < 3"))):
        got, want, _ = both(spark, t=left, u=right)
        assert got == want


def test_lengths(spark):
    t = table(spark, [(0, [1.0, 2.0]), (3, None), (4, [1.0]), (5, [])])
    with pytest.raises(PySparkException, match="arrays of different lengths"):
        dialect.query(spark, SQL, t=t, u=t).collect()
    for left, right in ((t.where("id = 0"), t.where("id IN (0, 3)")), (t.where("id = 3"), t), (table(spark, [(0, [])]), t.where("id = 5")), (table(spark, [(0, [])]), table(spark, [(0, [1.0])]))):
        got, want, _ = both(spark, t=left, u=right)
        assert got == want


@pytest.mark.parametrize(
    "old, new",
    [("q.id % 3 = 0 AND", ""), ("q.id % 3 = 0 AND", "e.id % 3 = 0 AND 2 < q.id AND"), ("<>", "!="), ("t q JOIN u e", "t AS q INNER JOIN u AS e"), ("n <= 4", "n < 4"), ("n <= 4", "x.n <= 4 ORDER BY a, n LIMIT 7"), ("array_distance(q.v, e.v) AS d", "array_distance(e.v, q.v) AS d")],
)
def test_forms(spark, old, new):
    sql = SQL.replace(old, new)
    assert dialect.nearest_form(sql)
    t = table(spark, [(i, [i * i % 17 + 0.0, i % 5 + 0.0]) for i in range(60)])
    got, want, _ = both(spark, sql, t=t, u=t)
    assert got == want and got


@pytest.mark.parametrize(
    "old, new",
    [("<>", "<"), ("q.id % 3 = 0 AND q.id <> e.id", "q.id <> e.id OR q.id = 3"), ("q.id % 3 = 0", "q.id % 3 = e.id % 3"), (", e.id)", ", e.id DESC)"), ("ORDER BY array_distance(q.v, e.v)", "ORDER BY array_distance(q.v, e.v) DESC"), ("JOIN", "LEFT JOIN"), ("n <= 4", "n >= 4"), ("n <= 4", "n <= 4 OR a = 1"), ("row_number", "rank"),
     ("PARTITION BY q.id", "PARTITION BY e.id"), ("e.id AS b", "e.id + 1 AS b"), ("SELECT q.id", "SELECT DISTINCT q.id"), ("e.id) x", "e.id WHERE e.id > 4) x")],
)
def test_other_selects_stay(spark, old, new):
    sql = SQL.replace(old, new)
    assert sql != SQL and dialect.nearest_form(sql) is None


def test_other_types_stay(spark):
    t = table(spark, [(i, [i % 7]) for i in range(20)], "array<int>")
    got, want, plan = both(spark, t=t, u=t)
    assert got == want and "zip_with" in plan
    named = t.select(F.col("id").cast("string"), F.col("v").cast("array<float>"))
    got, want, plan = both(spark, t=named, u=named)
    assert got == want and "zip_with" in plan
