"""Grouped models, aggregates with states, controls and table functions against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions.table_functions import register_table_functions
from turnwise.plans import grouped as G
from turnwise.plans import stats as A


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        for _ in range(rng.integers(1, 60)):
            a, b, c = (float(v) for v in rng.normal(1e6, 3, 3))
            y = 2 * a - b + float(rng.normal()) + g
            rows.append((None if g == 7 else f"g{g}", g % 3, a if rng.random() > 0.1 else None, float("nan") if rng.random() < 0.05 else b, c, y, g * 1.0))
    return spark.createDataFrame(rows, "g string, h long, a double, b double, c double, y double, flat double").repartition(6)


def complete(table, columns):
    return [r for r in table.collect() if all(r[c] is not None and r[c] == r[c] for c in columns)]


def plain_ols(x, y):
    """Estimates and standard errors with the intercept last, by refitting."""
    mid = x.mean(0)
    m = np.column_stack([x - mid, np.ones(len(y))])
    beta, *_ = np.linalg.lstsq(m, y, rcond=None)
    left = y - m @ beta
    df = len(y) - m.shape[1]
    cov = np.linalg.inv(m.T @ m) * (left @ left) / df
    return beta[:-1], np.sqrt(np.diag(cov))[:-1], df, 1 - left @ left / ((y - y.mean()) ** 2).sum()


def test_ols_by_equals_a_fit_of_each_group(table):
    got = {(r.g, r.h, r.term): r for r in G.ols_by(table, "y", ["a", "b"], ["g", "h"]).collect()}
    groups: dict = {}
    for r in complete(table, ["a", "b", "y"]):
        groups.setdefault((r.g, r.h), []).append(r)
    assert len(got) == 3 * len(groups) and (None, 1, "a") in got
    for key, rows in groups.items():
        n = len(rows)
        assert got[(*key, "a")].n == n and got[(*key, "a")].df == n - 3
        if n < 5:
            assert n > 3 or got[(*key, "a")].se is None
            continue
        beta, se, df, r2 = plain_ols(np.array([[r.a, r.b] for r in rows]), np.array([r.y for r in rows]))
        for k, term in enumerate("ab"):
            r = got[(*key, term)]
            assert np.allclose([r.estimate, r.se, r.r2, r.p], [beta[k], se[k], r2, A.student_p(beta[k] / se[k], df)], rtol=1e-5, atol=1e-9)
    assert G.ols_by(table, "y", ["a"], ["h"], least=10_000).count() == 0 and G.ols_by(table.limit(0), "y", ["a"], ["g"]).count() == 0
    flat = {r.term: r for r in G.ols_by(table.filter("g = 'g5'"), "y", ["flat", "a"], ["g"]).collect()}
    assert flat["flat"].estimate is None and flat["a"].estimate == pytest.approx(2, abs=0.5)


def test_aggregate_of_states_takes_groups_apart(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.g: r for r in G.partial_correlation_by(table, ["g"], "a", "y", "c").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups: dict = {}
    for r in complete(table, ["a", "y", "c"]):
        groups.setdefault(r.g, []).append((r.a, r.y, r.c))
    assert set(got) == set(groups)
    for key, rows in groups.items():
        v = np.array(rows)
        assert got[key].n == len(v)
        if len(v) < 4:
            assert got[key].r is None
        else:
            xy, xz, yz = (np.corrcoef(v[:, i], v[:, j])[0, 1] for i, j in ((0, 1), (0, 2), (1, 2)))
            assert got[key].r == pytest.approx((xy - xz * yz) / np.sqrt((1 - xz**2) * (1 - yz**2)), abs=1e-6)
    spread = lambda s: {"n": s[:, 0].astype(int), "hi": s[:, 1]}
    counts = G.grouped_aggregate(table.limit(0), ["g", "h"], ["a"], G.product_state, spread, {"n": "long", "hi": "double"})
    assert counts.columns == ["g", "h", "n", "hi"] and counts.count() == 0


@pytest.mark.parametrize("controls", [[], ["c"], ["c", "b"], ["c", "b", "flat"]])
def test_screen_with_any_number_of_controls(table, controls):
    got = {r.feature: r for r in A.screen(table, "y", ["a"], controls).collect()}
    rows = complete(table, ["a", "y", *controls])
    x = np.array([[r[c] for c in ["a", *controls]] for r in rows])
    y = np.array([r.y for r in rows])
    beta, se, df, r2 = plain_ols(x, y)
    r = got["a"]
    assert r.n == len(rows) and np.allclose([r.beta, r.t, r.df, r.r2], [beta[0], beta[0] / se[0], df, r2], rtol=1e-6)
    assert r.p == pytest.approx(A.student_p(beta[0] / se[0], df), abs=1e-9) and r.std_beta == pytest.approx(beta[0] * x[:, 0].std() / y.std(), rel=1e-6)


def test_controls_that_depend_on_each_other(table):
    d = table.withColumn("twice", F.col("c") * 2).withColumn("same", F.col("a") - F.col("c"))
    one, two = (A.screen(d, "y", ["a", "b"], k).orderBy("feature").collect() for k in (["c", "flat"], ["c", "twice", "flat"]))
    assert [r.beta for r in one] == pytest.approx([r.beta for r in two]) and [r.df - 1 for r in one] == [r.df for r in two]
    (lost,) = A.screen(d, "y", ["a"], ["c", "same"]).collect()
    assert lost.beta is None and lost.p is None
    grid = A.feature_outcome_grid(d, ["a", "b"], ["y", "c"], ["flat", "h"])
    assert grid.count() == 4 and {"p", "p_fdr"} <= set(grid.columns) and grid.filter("p_fdr < p - 1e-15").count() == 0


SRT = "1\n00:00:01,500 --> 00:00:02,000\n[SPEAKER_01]: so <u>well</u>\nthen\n\n\n2\n00:01:00.250 --> 01:00:00,000\nno speaker\n\nno time line\n\n3\n00:00:05,000 --> 00:00:06,000\n"
CUES = [(0, 1.5, 2.0, "SPEAKER_01", "so well then"), (1, 60.25, 3600.0, None, "no speaker"), (3, 5.0, 6.0, None, "")]


def test_table_functions(spark):
    register_table_functions(spark)
    files = spark.createDataFrame([("a", SRT), ("b", SRT), ("c", None), ("d", "")], "file string, value string")
    got = spark.sql("select f.file, c.* from {f} f, lateral srt_text_cues(f.value) c order by file, cue_idx", f=files).collect()
    assert [tuple(r) for r in got] == [(f, *c) for f in "ab" for c in CUES]
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line")).repartition(3)
    got = spark.sql("select * from srt_cues(table(select * from {l}) partition by (file) order by (n), 'line', 'file') order by file, cue_idx", l=lines).collect()
    assert [tuple(r) for r in got] == [(f, *c) for f in "ab" for c in CUES]
    with pytest.raises(Exception, match="no column nowhere"):
        spark.sql("select * from srt_cues(table(select * from {l}) partition by (file) order by (n), 'nowhere', 'file')", l=lines)


def test_table_function_takes_rows_of_many_lines(spark):
    """Arrays of lines, cut anywhere, give the cues of single lines."""
    from turnwise.functions.table_functions import register_table_functions

    register_table_functions(spark)
    text = ["1", "00:00:01,000 --> 00:00:02,500", "[SPEAKER_01]: so <u>it</u>", "goes", "", "", "2", "00:00:03,000 --> 00:00:04,000", "on", "", "x", None, "3", "00:01:00,000 --> 00:01:01,000", "and on"]
    lines = spark.createDataFrame([(f, n, text[n : n + k]) for f, k in (("a", 1), ("b", 2), ("c", 4), ("d", 99)) for n in range(0, len(text), k)], "file string, n int, lines array<string>")
    got = spark.sql("select * from srt_cues(table(select * from {l}) partition by (file) order by (n), 'lines', 'file')", l=lines).collect()
    cues = {f: sorted(tuple(r)[1:] for r in got if r.file == f) for f in "abcd"}
    assert [c[0] for c in cues["a"]] == [0, 1, 3] and all(c == cues["a"] for c in cues.values())


def test_query_of_cue_lines_has_a_row_for_many_lines(spark):
    from turnwise import queries as own
    from turnwise.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    files, rows = own._cue_files(t).count(), own._cue_lines(t).count()
    assert rows == files and own._cue_lines(t, 2).count() > rows
