import os

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from framesift.plans.oracle import ORACLE as SQL
from framesift.plans.queries import QUERIES
from framesift.session import new_shared_path, shared_dir

EMPTY_AT_THIS_SCALE = {"embed_pending"}  # every document has a vector in the smallest tables


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def built(spark):
    """Each query built once: many do their work on the way."""
    frames = {}

    def build(name):
        def once(spark, sf_dir):
            if name not in frames:
                frames[name] = QUERIES[name](spark, sf_dir)
            return frames[name]

        return once

    return build


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, built, name):
    problem = compare(spark, con, built(name), SQL.get(name), sf)
    assert problem == "" or (problem == "no rows" and name in EMPTY_AT_THIS_SCALE)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"kmeans_sizes"}


def test_cells_are_many(spark):
    """The queries by cells run over more than one cell."""
    from framesift.operators import blocks
    from framesift.plans import inputs, queries

    vectors = inputs.keyed_vectors(spark, "/root/testdata/sf0.01")
    count = vectors.count()
    cells = blocks.cell_count(count, inputs.DIMENSION, queries.SMALL_BLOCKS)
    assert cells >= 16 and len(blocks.choose_pivots(vectors, cells, count)[0]) >= 12
    assert count > blocks.rows_within_budget(inputs.DIMENSION, queries.CELLS["max_broadcast_bytes"])


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf, built, name):
    plan = built(name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = new_shared_path(spark, "x")
    assert path.startswith(shared_dir(spark)) and not os.path.exists(path)
