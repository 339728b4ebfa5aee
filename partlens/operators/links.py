"""Accessory links: same family or same page, without expanding product x accessory pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.plans.scale import top_k


def _first_per_group(accessories: DataFrame, group: str, n: int, name: str) -> DataFrame:
    """The first ``n`` accessories of every group, by input order, as one bounded array per group."""
    listed = accessories.filter(F.col(group).isNotNull())
    best = top_k(listed.select(group, "ord", "order_number"), [group], [F.asc("ord")], n)
    return best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", "order_number"))).alias(name))


def _ids(entries: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(entries, lambda e: e["order_number"]), empty)


def top_accessories(products: DataFrame, accessories: DataFrame, n: int = 6) -> DataFrame:
    """(order_number, accessories): the first ``n`` accessories of each product, family before page.

    ``n`` family entries and ``2 n`` page entries decide the answer exactly: page
    entries that repeat the family are at most as many as the family list has.
    """
    by_family = _first_per_group(accessories, "family", n, "_family")
    by_page = _first_per_group(accessories, "source_page", 2 * n, "_page")
    linked = products.join(by_family, "family", "left").join(by_page, "source_page", "left")
    both = F.array_distinct(F.concat(_ids(F.col("_family")), _ids(F.col("_page"))))
    return linked.select("order_number", F.slice(both, 1, n).alias("accessories"))


def accessory_counts(products: DataFrame, accessories: DataFrame) -> DataFrame:
    """How many accessories each product has in all: family plus page minus the ones in both."""
    def count(*keys: str, name: str) -> DataFrame:
        return accessories.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct("order_number").alias(name))

    out = products.select("order_number", "family", "source_page")
    out = out.join(count("family", name="in_family"), "family", "left")
    out = out.join(count("source_page", name="on_page"), "source_page", "left")
    out = out.join(count("family", "source_page", name="in_both"), ["family", "source_page"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("in_family") + zero("on_page") - zero("in_both")
    return out.select("order_number", total.alias("n_accessories"))


def link_table(accessories: DataFrame) -> DataFrame:
    """Every link as (scope, key, accessory): a product owns the rows of its family and of its page."""
    family = accessories.filter("family is not null").select(
        F.lit("family").alias("scope"), F.col("family").alias("key"), "order_number", "ord"
    )
    page = accessories.select(F.lit("page").alias("scope"), F.col("source_page").alias("key"), "order_number", "ord")
    return family.unionByName(page)
