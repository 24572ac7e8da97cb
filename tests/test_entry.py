"""Every registered query with SQL, on the smallest scale, against DuckDB; the rest for rows."""

import os

import duckdb
import pandas as pd
import pytest

from lumenframe.plans import registry

SF = "/root/testdata/sf0.001"
#: A cross-section; the driver compares all of them.
NAMES = ["hist_equalize", "hist_quantile", "blur5x5", "box_meandisp", "erode_cross", "median3x3", "expand2_smooth", "canny_edges", "cc_moments", "killblik", "radius_hist", "seq_line_median", "det_curve", "circle_fit", "cov_within", "haar", "single_linkage", "affine_rgb_grey", "scale_bayer_grey", "rubber_sheet", "polar_between", "edge_slopes", "chess_rising", "sobel_21", "dft_2d", "walsh_2d", "side_projection", "disc_erode4", "motion", "sharpness", "matmul_ab", "linear_solve", "fixed_functions", "stretch_roi", "fill_half_ring"]


def rows(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(registry.ORACLE_SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=2e-6)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bench_names():
    import __spark_entry__ as entry
    import bench

    found = bench.names(entry.queries())
    assert len(found) == len(set(found)) and set(bench.HEADLINE) <= set(found) <= set(entry.queries())
    numbers = [int(m[1]) for n in found if (m := bench.CORPUS.match(n))]
    assert numbers == sorted(numbers) and "opening" not in found
