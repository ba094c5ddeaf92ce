"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from spotweave.plans import model_queries, more_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    want = oracle.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_joins_have_no_nested_loops(spark):
    for name in ("radius_join_euclidean", "neighborhood_composition", "covered_cells", "uncovered_cells", "overlap_pairs"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.parametrize("score", [0.05033749999999999, 0.0503375])
def test_segment_scores_halfway_sums_do_not_depend_on_their_order(spark, monkeypatch, score):
    """Both are sums of the same six shares in different orders; their exact total, 4027 / 80000, is halfway between two results."""
    monkeypatch.setattr(more_queries, "scores", lambda spark, d: spark.createDataFrame([(1, "error", score)], "cell_id long, cell_type string, score double"))
    assert more_queries.segment_scores(spark, SF).first().score == 0.050338


def broadcast_generates(plan: str) -> list[str]:
    """Lines of a plan that unfold rows below a broadcast."""
    found, at = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if at is not None and depth <= at:
            at = None
        if "BroadcastExchange" in line:
            at = depth
        elif at is not None and "Generate" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["segment_scores", "neighbor_graph", "neighborhood_composition", "overlap_pairs", "largest_remainder_quota", "assignment_counts"])
def test_unfolded_rows_are_not_broadcast(spark, name):
    """Spark takes nine rows of a cell for as small as the one they come from; sent to all tasks they burst the driver."""
    assert not broadcast_generates(queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
