"""What one task holds does not grow with the tables."""

import re

import pytest
from pyspark.sql import functions as F

from loomframe.plans.registry import ORACLES, QUERIES
from loomframe.sources import adapters as V
from loomframe.sources import files
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["region_order", "reading_order", "suppress_nested", "spaced_cuts"])
def test_folds_of_pages_go_on_in_the_tasks_that_number_boxes(spark, name, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 500)
    rows = QUERIES[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1, plan
    by_task = V.boxes(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) == 12 and max(x["count"] for x in by_task) < 1000
    assert len(rows.select(F.spark_partition_id()).distinct().collect()) == 12
    compare(spark, name, SF, QUERIES, ORACLES)


@pytest.mark.parametrize("name", ["bbox_bounds", "component_classes", "detector_choice"])
def test_sums_over_boxes_are_made_before_the_exchange(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange", plan)) == 1 and "Window" not in plan
    assert "partial_" in plan.split("Exchange")[1]


def test_narrations_lie_in_as_many_folders_for_any_number_of_chapters(spark, tmp_path):
    rows = [(c, p, f"p{p % 3}.jpg" if p != 4 else None, f"t{c}\n{p}" if p != 5 else None) for c in (*range(-20, 300), None) for p in range(6)]
    rows += [(7, p, f"p{p}.jpg", "hot") for p in range(10, 3000)]
    path = str(tmp_path / "narrations")
    files.write_narrations(spark.createDataFrame(rows, "chapter long, pos long, image string, text string").repartition(7), path)
    assert len([f for f in (tmp_path / "narrations").iterdir() if f.is_dir()]) == files.SHELVES + 1
    assert len(list((tmp_path / "narrations").rglob("*.json"))) < 2 * files.SHELVES
    want = {}
    for c, p, image, text in sorted(rows, key=lambda r: r[1]):
        if image is not None and text is not None:
            want[c, image] = text
    got = [tuple(x) for x in files.read_narrations(spark, path).select("chapter", "image", "text").collect()]
    assert len(got) == len(want) and {(c, i): t for c, i, t in got} == want
    some = files.read_narrations(spark, path, [7, 71, -1, 10_000])
    assert {(x.chapter, x.image): x.text for x in some.collect()} == {k: t for k, t in want.items() if k[0] in (7, 71, -1)}
    assert re.search(r"PartitionFilters: \[[^\]]*shelf", some._jdf.queryExecution().executedPlan().toString())
