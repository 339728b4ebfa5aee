"""Hybrid search: lexical and dense lanes over the cards a requirement allows, fusion, rerank, citation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators import chunks as C
from partlens.operators import retrieval as R
from partlens.operators.solve import prefilter_pairs
from partlens.plans.scale import clamp_k, shuffled
from partlens.session import cut_lineage
from partlens.sources import posting_store

# A first window holds so many times the wanted rows; each further window reaches so many times as deep.
FIRST_WINDOW, WIDER = 4, 4


def surviving(index: dict[str, DataFrame], asked: DataFrame, reqs: DataFrame, found: DataFrame) -> DataFrame:
    """Those rows of ``found`` (query_id, item, ...) whose card the query's requirement allows.

    A row card needs its product to survive the requirement; a family card needs
    any row of its family to; a query without a requirement may rank everything.
    Verdicts are evaluated for the products of found cards only.
    """
    cards = index["chunk"].select(F.col("id").alias("item"), "kind", "order_number", "document_id")
    named = found.select("query_id", "item").join(asked.select("query_id", "req_id"), "query_id").join(shuffled(cards), "item")
    rows = named.filter("kind = 'sku' and req_id is not null").select("query_id", "item", "req_id", "order_number")
    families = named.filter("kind = 'family' and req_id is not null").select("query_id", "item", "req_id", "document_id")
    members = families.select("req_id", "document_id").distinct().join(
        shuffled(cards.filter("kind = 'sku'").select("document_id", "order_number")), "document_id"
    )
    pairs = rows.select("req_id", "order_number").unionByName(members.select("req_id", "order_number"))
    alive = cut_lineage(prefilter_pairs(index["product"], index["spec"], reqs, pairs))
    lively = members.join(alive, ["req_id", "order_number"], "left_semi").select("req_id", "document_id").distinct()
    free = named.filter("req_id is null").select("query_id", "item")
    kept = rows.join(alive, ["req_id", "order_number"], "left_semi").select("query_id", "item").unionByName(
        families.join(lively, ["req_id", "document_id"], "left_semi").select("query_id", "item")
    ).unionByName(free)
    return found.join(kept, ["query_id", "item"], "left_semi")


def refill(index: dict[str, DataFrame], asked: DataFrame, reqs: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], k: int) -> DataFrame:
    """The first ``k`` allowed rows of every query out of a lane: (query_id, item, score, rank).

    ``fetch(queries, n)`` gives the lane's first ``n`` rows of the queries.  A window of
    a few times ``k`` rows is judged first; queries that it leaves short, and whose
    lane goes on, get a deeper one, until each has its rows or the lane ends.  All rows
    down to a window's end are judged, so the result is that of judging all pairs.
    """
    open_, kept, start, to = asked, None, 0, FIRST_WINDOW * k
    while True:
        window = cut_lineage(fetch(open_, to))
        fresh = window.filter(F.col("rank") >= start)
        passed = cut_lineage(surviving(index, open_, reqs, fresh))
        kept = passed if kept is None else kept.unionByName(passed)
        reached = window.groupBy("query_id").agg(F.count("*").alias("reached")).filter(F.col("reached") >= to).select("query_id")
        enough = kept.groupBy("query_id").agg(F.count("*").alias("kept")).filter(F.col("kept") >= k).select("query_id")
        open_ = cut_lineage(open_.join(reached, "query_id", "left_semi").join(enough, "query_id", "left_anti"))
        if open_.isEmpty():
            return R.lane_rank(kept.select("query_id", "item", "score"), k)
        start, to = to, to * WIDER


def lexical_scores(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, item, score) of every chunk that holds a term of a query, out of stored postings where the index has them."""
    if "postings" in index:
        return posting_store.matched(queries, index["postings"])
    return R.sum_weights(R.bm25_pairs(queries, index["posting"], index["stats"]))


def hybrid_search(index: dict[str, DataFrame], queries: DataFrame, reqs: DataFrame | None = None,
                  rerank: Callable[[str, list[str]], list[float]] | None = None, top: int | None = None,
                  candidate_k: int | None = None, dense: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """Ranked, cited chunks of every query (query_id, text, optional embedding, optional req_id).

    ``index`` holds chunk, vector, product, spec and family tables, and either stored
    ``postings`` or posting and stats tables.  Lane ranks are NULL where a lane did
    not run or did not find the item.
    """
    k = clamp_k(top, 10)
    lane_k = clamp_k(candidate_k, R.CANDIDATES)
    asked = cut_lineage(queries.filter(F.trim("text") != ""))
    scores = cut_lineage(lexical_scores(index, asked))
    fetches = {"bm25": lambda part, n: R.lane_rank(scores.join(part.select("query_id"), "query_id", "left_semi"), n)}
    if dense and "embedding" in queries.columns:
        fetches["dense"] = lambda part, n: R.dense_search(part, index["vector"], n, "chunk_id")
    filtered = reqs is not None and "req_id" in queries.columns
    union = None
    for name, fetch in fetches.items():
        found = refill(index, asked, reqs, fetch, lane_k) if filtered else fetch(asked, lane_k)
        lane = found.withColumn("lane", F.lit(name))
        union = lane if union is None else union.unionByName(lane)
    fused = R.rrf(union, ["bm25", "dense"], weights=weights)
    scored = R.rerank_with(fused, index["chunk"], asked, rerank) if rerank else None
    best = R.merge_rerank(fused, scored, k=k)
    return C.cite(best, index["chunk"], index["product"], index["family"])


def retrieved_ids(results: DataFrame) -> DataFrame:
    """Distinct order numbers of a result list, each at its best rank."""
    return results.filter("order_number is not null").groupBy("query_id", "order_number").agg(F.min("rank").alias("rank"))
