"""Postings as stored tables that a search joins without moving them.

A version folder holds ``posting`` (term, share, id, tf, length), bucketed and sorted
by term and share, ``term`` (term, df, total_tf, shares) and one row of ``corpus``
statistics.  A rare term has one share, a term in more than ``share_rows`` chunks has
several, dealt by chunk, so no bucket holds all of a hot term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.operators import postings as P
from partlens.operators import retrieval as R
from partlens.plans.scale import at_most
from partlens.session import cut_lineage

# Buckets of the postings, chunks of a term that make a share, postings that a bucket holds and that a task of a search sorts.
BUCKETS, SHARE_ROWS, BUCKET_ROWS, TASK_ROWS = 64, 100_000, 2_000_000, 1_000_000


@dataclass(frozen=True)
class Postings:
    """Stored postings: the bucketed table, the terms, and the corpus' size and average length."""

    posting: DataFrame
    term: DataFrame
    n_docs: int
    avg_length: float | None


def write_postings(chunks: DataFrame, version: str, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS, share_rows: int = SHARE_ROWS) -> None:
    """Count the terms of ``chunks`` in one pass and write the tables under the folder ``version``, in more than ``buckets`` where one would hold over BUCKET_ROWS."""
    rows = cut_lineage(P.index_rows(chunks, id_col, text_col))
    # The rows of the chunks themselves are the group without a term.
    counted = cut_lineage(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.sum("length").alias("length")))
    stated = rows.filter("term is not null")
    terms = counted.filter("term is not null").select("term", "df", "total_tf", F.ceil(F.col("df") / share_rows).alias("shares"))
    buckets = max(buckets, -(-(terms.agg(F.sum("df")).first()[0] or 0) // BUCKET_ROWS))
    terms.repartition(buckets, "term").sortWithinPartitions("term").write.parquet(f"{version}/term")
    # Only terms of several shares take part in the join: at most one for every ``share_rows`` postings.
    hot = terms.filter("shares > 1").select("term", "shares")
    hot = F.broadcast(hot) if at_most(hot, R.BROADCAST_TERMS) else hot
    share = F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1)))
    dealt = stated.join(hot, "term", "left").select("term", share.alias("share"), "id", "tf", "length")
    name = f"posting_{uuid.uuid4().hex}"
    writer = dealt.repartition(buckets, "term", "share").write.bucketBy(buckets, "term", "share").sortBy("term", "share")
    writer.option("path", f"{version}/posting").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")
    kind = dict(rows.dtypes)["id"]
    corpus = counted.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), (F.sum("length") / F.sum("df")).alias("avg_length"))
    corpus.withColumns({"buckets": F.lit(buckets), "id_type": F.lit(kind)}).coalesce(1).write.parquet(f"{version}/corpus")


def read_postings(spark: SparkSession, version: str) -> Postings:
    """The tables of a version folder; the postings know their buckets."""
    corpus = spark.read.parquet(f"{version}/corpus").first()
    name = f"posting_{uuid.uuid5(uuid.NAMESPACE_URL, version).hex}"
    columns = f"term STRING, share BIGINT, id {corpus.id_type}, tf INT, length INT"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (term, share) SORTED BY (term, share) INTO {corpus.buckets} BUCKETS LOCATION '{version}/posting'"
    )
    terms = spark.read.schema("term STRING, df BIGINT, total_tf BIGINT, shares BIGINT").parquet(f"{version}/term")
    return Postings(spark.table(name), terms, corpus.n_docs, corpus.avg_length)


def validate_postings(stored: Postings) -> None:
    """Refuse postings whose counts do not add up with the terms and the corpus."""
    told = stored.term.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("rows"), F.coalesce(F.sum("total_tf"), F.lit(0)).alias("tf")).first()
    held = stored.posting.agg(F.count("*").alias("rows"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tf")).first()
    if tuple(told) != tuple(held):
        raise ValueError(f"postings hold {held.rows} rows and {held.tf} words, their terms tell {told.rows} and {told.tf}")


def asked_shares(queries: DataFrame, stored: Postings) -> DataFrame:
    """(query_id, term, qtf, df, share): the shares that hold the terms of the queries."""
    asked = R.query_terms(queries).join(stored.term.select("term", "df", "shares"), "term")
    return asked.select("query_id", "term", "qtf", "df", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))


def matched(queries: DataFrame, stored: Postings, **params: float) -> DataFrame:
    """(query_id, item, score) of every chunk that holds a term of a query; the asked terms go to the postings, which stay in place."""
    hits = stored.posting.join(asked_shares(queries, stored), ["term", "share"])
    weight = R.bm25_weight(F.col("tf"), F.col("df"), F.col("length"), F.lit(stored.n_docs), F.lit(stored.avg_length), **params)
    return R.sum_weights(hits.select("query_id", F.col("id").alias("item"), (F.col("qtf") * weight).alias("w")))


def search(queries: DataFrame, stored: Postings, k: int = R.CANDIDATES, **params: float) -> DataFrame:
    """(query_id, item, score, rank): BM25 top ``k`` out of stored postings.

    While the asked terms are few (a checked bound) their postings, not their pairs with
    the queries, are dealt by chunk and summed there; more of them are joined.
    """
    asked = cut_lineage(R.query_terms(queries))
    if not at_most(asked, R.BROADCAST_TERMS):
        return R.lane_rank(matched(queries, stored, **params), k)
    told = asked.join(stored.term.select("term", "df", "shares"), "term").collect()
    shares = {r.term: (r.df, r.shares) for r in told}
    number = {t: i for i, t in enumerate(sorted(shares))}
    entries = [(r.query_id, number[r.term], r.qtf, r.df) for r in told]
    held = [(t, s, number[t]) for t, (_, n) in shares.items() for s in range(n)]
    wanted = F.broadcast(queries.sparkSession.createDataFrame(held, "asked string, asked_share long, number int"))
    met = stored.posting.join(wanted, (F.col("term") == F.col("asked")) & (F.col("share") == F.col("asked_share")))
    rows = met.select("id", "length", F.col("number").alias("term"), "tf")
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(df for df, _ in shares.values()) // TASK_ROWS))
    dealt = rows.repartition(parts, "id").sortWithinPartitions("id", "term")
    return R.best_chunks(dealt, entries, stored.n_docs, stored.avg_length, queries, k, **params)
