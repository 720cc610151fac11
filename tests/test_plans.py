"""Physical plans: what must not be in them, and what must reach the scans."""

import re

import pytest

from annogrid.plans import catalog

DATA = "/root/testdata/sf0.001"
#: Queries that train models or run loops on the way to their plan.
LOOPS = {"kmeans_labels", "gmm_labels", "best_k", "rf_importance", "ward_labels", "dbscan_labels", "overlap_groups", "overlap_invalid", "all_invalid", "nested_annotations", "merge_annotation_ids", "merge_annotation_ids_strict", "merge_images", "merge_categories", "box_shapes"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LOOPS))
def test_no_cartesian_product(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text  # row-at-a-time functions


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["filter_by_category"](spark, DATA))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert all("l_tax" not in s and "p_retailprice" not in s for s in schemas)
    assert "IsNotNull(l_partkey)" in text


def test_range_joins_are_equi_joins(spark):
    text = plan(catalog.QUERIES["overlap_pairs"](spark, DATA))
    assert re.search(r"(SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) \[image_id", text)


def test_tiles_are_cut_for_each_resolution_alone(spark):
    text = plan(catalog.QUERIES["tiles_by_resolution"](spark, DATA))
    below = text[text.rindex("HashAggregate") :]
    assert "array_distinct" not in below and "sequence" not in below
