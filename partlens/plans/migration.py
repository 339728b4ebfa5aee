"""Migration of requirements to recommendations: sufficiency, retrieval, solving, challenge, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators import audit as A
from partlens.operators import compare as CP
from partlens.operators import solve as S
from partlens.operators.retrieval import CANDIDATES
from partlens.plans.search import hybrid_search, retrieved_ids
from partlens.session import cut_lineage


def migrate(index: dict[str, DataFrame], reqs: DataFrame, terms: dict[str, dict[str, str]] | None = None, retrieved: int | None = None) -> DataFrame:
    """One outcome per requirement: needs_input with its questions, a recommendation, or no_equivalent with the closest.

    Every product is solved, so one that can pass is found whatever its card says.  With
    ``retrieved`` only the products among so many hits of the requirement's text
    (``terms``) are; a requirement whose text is empty is still solved over all.
    """
    req = S.complete(reqs, S.REQUIREMENT)
    assessed = cut_lineage(CP.sufficiency(reqs))
    ready = req.join(assessed.filter("sufficient").select("req_id"), "req_id", "left_semi")
    if retrieved is None:
        solved = S.solve(index["product"], index["spec"], ready, A.MAX_CHALLENGED)
    else:
        texts = A.retrieval_query(ready, terms or {})
        queries = texts.filter("text != ''").select(F.col("req_id").alias("query_id"), "text", "req_id")
        found = retrieved_ids(hybrid_search(index, queries, ready, top=retrieved, candidate_k=max(retrieved, CANDIDATES), dense=False))
        nominated = found.select(F.col("query_id").alias("req_id"), "order_number")
        silent = ready.join(texts.filter("text = ''"), "req_id", "left_semi")
        solved = S.solve_candidates(index["product"], index["spec"], ready, nominated, A.MAX_CHALLENGED).unionByName(
            S.solve(index["product"], index["spec"], silent, A.MAX_CHALLENGED)
        )
    # A handful of rows per requirement, read by every later step.
    return decide(assessed, cut_lineage(solved))


def decide(assessed: DataFrame, solved: DataFrame) -> DataFrame:
    """Outcomes out of solved rows: the first survivor of the challenge, with confidence and losses."""
    head = solved.filter(F.col("rank") <= A.MAX_CHALLENGED)
    judged = A.judge(head).withColumn("losses", A.losses())
    winners = A.first_survivor(judged)
    chosen = winners.withColumn("pick", F.coalesce("order_number", "closest"))
    detail = judged.select("req_id", F.col("order_number").alias("pick"), "passed", "failed", "unknown", "confidence", "losses")
    told = chosen.join(detail, ["req_id", "pick"])
    listed = CP.question_queue(assessed).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("rank", "field"))).alias("_q"))
    out = assessed.select("req_id", "sufficient", "reason").join(told, "req_id", "left").join(listed, "req_id", "left")
    outcome = (
        F.when(~F.col("sufficient"), "needs_input").when(F.col("order_number").isNotNull(), "recommendation").otherwise("no_equivalent")
    )
    return out.select(
        "req_id", outcome.alias("outcome"), "reason", "order_number", "closest", "promoted_from", "n_challenged",
        "passed", "failed", "unknown", "confidence", "losses",
        F.when(~F.col("sufficient"), F.transform("_q", lambda q: q["field"])).alias("questions"),
    )
