"""Queries against their SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = (
    "norms label_centroids label_cost total_cost huygens_cost centroids_with_empty assign_nearest second_nearest lloyd_step dual_lower_bound "
    "initial_columns graph_density disc_vertices isolated_discs vertex_sbase candidate_sets singleton_rc column_filter ryan_foster_pair label_extraction k_sweep_cost "
    "jump_candidates jump_screen kmeanspp_seeds farthest_first_seeds qp_exhaustive fractional_ratio pricing_counts ryan_foster_columns ryan_foster_column_pair isolated_index_sets same_components "
    "graph_edges oriented_neighborhoods bnb_result bnb_assignment subproblem_gradient label_count column_overlap negative_columns best_columns"
).split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def same(spark, con, query, sql):
    got, want = query(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    import __spark_entry__ as entry

    same(spark, con, entry.queries()[name], entry.oracle_sql()[name])


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
