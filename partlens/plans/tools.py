"""The query calls over an index, taking tables of ids or questions and returning tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators import compare as CP
from partlens.operators import solve as S
from partlens.operators.coverage import coverage
from partlens.plans.scale import clamp_k
from partlens.plans.search import hybrid_search
from partlens.sources.index_store import provenance


def search_catalog(index: dict[str, DataFrame], queries: DataFrame, reqs: DataFrame | None = None, top: int | None = None, **options) -> DataFrame:
    return hybrid_search(index, queries, reqs, top=clamp_k(top, 10), **options)


def get_product(index: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    return CP.get_product(index["product"], index["spec"], ids)


def solve_constraints(index: dict[str, DataFrame], reqs: DataFrame, top: int | None = None, viable_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ranked rows with verdicts and evidence, totals per requirement); a requirement must state something."""
    stated = S.complete(reqs, S.REQUIREMENT).withColumn("_stated", CP.stated_fields())
    empty = (F.size("_stated") == 0) & (F.coalesce(F.size("row_type"), F.lit(0)) <= 0)
    message = F.concat(F.lit("requirement states no constraint: "), "req_id")
    checked = stated.where(F.when(~empty, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_stated")
    ranked = S.solve(index["product"], index["spec"], checked, clamp_k(top, 20), viable_only)
    return S.evidence_summary(ranked), S.solve_totals(index["product"], index["spec"], checked)


def compare_products(index: dict[str, DataFrame], groups: DataFrame, differences_only: bool = False) -> DataFrame:
    wanted = index["product"].join(groups.select("order_number").distinct(), "order_number", "left_semi")
    return CP.compare(CP.describe_specs(wanted, index["spec"]), groups, differences_only)


def list_family(index: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    return CP.list_family(index["product"], names, index["family"])


def index_stats(index: dict[str, DataFrame], fields: list[str], source_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """(counts of the index, coverage of the given spec fields)."""
    return provenance(index, source_dir), coverage(index["spec"], fields)
