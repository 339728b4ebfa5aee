"""Checks that refuse bad input do so whatever the caller reads."""

import pytest
from pyspark.sql import functions as F

from partlens.operators import compare, paged
from partlens.plans import tables, tools
from partlens.sources.schemas import REQUIREMENT, complete

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [["a"], list("abcdef"), ["a", "a"]])
def test_comparisons_need_two_to_five_parts(spark, parts):
    described = spark.createDataFrame([(p, 0, "f", "x", True) for p in "abcdef"], "order_number string, position int, field string, value string, stated boolean")
    groups = spark.createDataFrame([("g", p) for p in parts] + [("h", "a"), ("h", "b")], "group_id string, order_number string")
    out = compare.compare(described, groups)
    for read in (out.count, out.select("field").collect, out.collect):
        with pytest.raises(Exception, match="2 to 5 distinct parts"):
            read()


def test_requirements_must_state_something(spark):
    index = {"product": tables.products(spark, SF), "spec": tables.specs(spark, SF)}
    empty = complete(spark.createDataFrame([("r",)], "req_id string"), REQUIREMENT)
    for read in (lambda: tools.solve_constraints(index, empty)[0].select("order_number").collect(), lambda: tools.solve_constraints(index, empty)[1].count()):
        with pytest.raises(Exception, match="states no constraint"):
            read()


def test_paged_sets(spark):
    """No page is longer than asked; NULL keys are keys, NULL values are left out, repeated values count once."""
    rows = [("hot", i % 700) for i in range(3000)] + [(None, 5), (None, 5), ("x", None), ("y", -3)]
    found = paged.paged_sets(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", 64).collect()
    hot = sorted((r.page, r.entries) for r in found if r.k == "hot")
    assert [v for _, page in hot for v in page] == list(range(700)) and max(len(page) for _, page in hot) == 64 and len(hot) == 11
    assert {(r.k, r.page, r.n, tuple(r.entries)) for r in found if r.k != "hot"} == {(None, 0, 1, (5,)), ("y", 0, 1, (-3,))}
    assert {r.n for r in found if r.k == "hot"} == {700}
    texts = spark.createDataFrame([("k", f"{i:04x}") for i in range(300)], "k string, v string")
    pages = paged.paged_sets(texts, ["k"], "v", 100).orderBy("page").select(F.get("entries", F.lit(0)).alias("first")).collect()
    assert [r.first for r in pages] == ["0000", "0064", "00c8"]
