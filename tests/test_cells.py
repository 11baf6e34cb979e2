"""Dosages in small rows, which become cells in the worker alone, against the plain ways."""

import re

import numpy as np
import pyarrow as pa
import pytest

from genoloom import catalogue
from genoloom import fixtures as fx
from genoloom.functions import cells

from .conftest import DATA

#: Queries whose joins and shuffles hold no dosages.
SMALL_ROWS = [
    "afs_diploid",
    "afs_maxmiss_poly",
    "afs_pivot_counts",
    "afs_population_subset",
    "afs_pseudohap_adjusted",
    "afs_sex_chrom",
    "bind_sample_counters",
    "dosage_swap",
    "gate_target_call_rate",
    "pseudohap_sidecar",
    "inspect_missingness",
    "pseudohap_mix",
    "pseudohap_status",
    "bind_long",
]


@pytest.mark.parametrize("name", SMALL_ROWS)
def test_dosages_are_not_joined(spark, name):
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert not re.search(r"\b_?g\d?#", plan[plan.index("MapInArrow") :].split("\n", 1)[1])


def _matrix(spark, n, width):
    g = np.random.default_rng(width).choice([0, 1, 2, -1], size=(n, width)).astype(np.int8)
    rows = [(k, [None if x < 0 else x for x in row]) for k, row in enumerate(g.tolist())]
    rows += [(n, None), (n + 1, rows[0][1][: width // 2])]
    return spark.createDataFrame(rows, "row_idx long, g array<tinyint>").repartition(3)


@pytest.mark.parametrize("width", [5, 2500])
def test_sums_are_those_of_arrays(spark, width):
    df = _matrix(spark, 20, width)
    form = cells.packed(df, width)
    ploidy = [1 if p % 3 == 0 else 2 for p in range(width)]
    groups = [list(range(0, width, 2))[::-1], [], [1], list(range(width))]
    whole = df.where("row_idx <= 20")
    want = {r.row_idx: (list(r.alt_count), list(r.called)) for r in cells.group_sums(whole, "g", groups, ploidy).collect()}
    assert {r.row_idx: (list(r.alt_count), list(r.called)) for r in cells.packed_group_sums(whole, form, groups, ploidy).collect()} == want
    per_place = {r.out_ord: (r.het, r.called) for r in cells.place_sums(df).collect()}
    got = cells.packed_sums(df, form).collect()
    assert {r.place: (r.het, r.called) for r in got} == per_place and {r.n for r in got} == {22}


def test_unpacked_places_and_swaps(spark):
    df = _matrix(spark, 12, 9).selectExpr("row_idx", "g", "row_idx % 2 = 0 as swap", "g as h")
    form = cells.packed(df, 9)
    got = {r.row_idx: r.g for r in cells.unpacked(df, [(form, ["g"], [8, 0, 3], [0, 1, 4], "swap"), (form, ["h"], [2, 2], [2, 3], None)], 6).collect()}
    for r in df.collect():
        g = [(None if r.g is None or p >= len(r.g) or r.g[p] is None else r.g[p]) for p in (8, 0, 3, 2)]
        a, b, c = [None if x is None else 2 - x if r.swap else x for x in g[:3]]
        assert got[r.row_idx] == [a, b, g[3], g[3], c, None]


def test_formula_repeats_itself():
    s = np.array([0, 1, 5, 13, 208, 59_999])
    ph, places = s % 3 == 0, np.array([4, -1, 0, 5])
    read = fx._formula_reader(s, ph, places)
    k = [0, 7, 207, 208, 1_199_999, None]
    got = read([pa.array(k, pa.int64())])
    for row, x in zip(got.tolist(), k, strict=True):
        for cell, p in zip(row, places.tolist(), strict=True):
            h = None if p < 0 or x is None else (x * 31 + int(s[p]) * 17 + (x * int(s[p])) % 13) % 16
            assert cell == (-1 if h in (None, 15) else x % 2 * 2 if ph[p] and h % 3 == 1 else h % 3)
    odd = fx._formula_reader(-s, ph, places)([pa.array([-3, 4], pa.int64())])
    want = [[int(np.fmod(np.fmod(x * 31 - v * 17 + np.fmod(-x * v, 13), 16), 3)) for v in (208, 59_999)] for x in (-3, 4)]
    assert [[row[0], row[3]] for row in odd.tolist()] == want


def test_lists_of_samples_and_dosages():
    of, v = pa.array([[9, 3, 4], None, []], pa.list_(pa.int64())), pa.array([[2, None, 1], None, []], pa.list_(pa.int8()))
    assert fx._sparse_reader(np.array([3, 5, 9]), np.arange(3))([of, v]).tolist() == [[-1, -1, 2], [-1] * 3, [-1] * 3]
    assert fx._sparse_reader(np.array([9, 5, 9]), np.array([2, -1, 0]))([of, v]).tolist() == [[2, -1, 2], [-1] * 3, [-1] * 3]
    assert fx._sparse_reader(np.array([], np.int64), np.array([-1]))([of, v]).tolist() == [[-1]] * 3
