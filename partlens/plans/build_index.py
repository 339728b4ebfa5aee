"""From catalog tables to a retrieval index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.operators import chunks as C
from partlens.operators import postings as P
from partlens.operators import retrieval as R
from partlens.operators.normalize import normalize_spec
from partlens.session import cut_lineage
from partlens.sources import catalog, index_store
from partlens.sources.schemas import FAMILY, complete


def index_tables(products: DataFrame, families: DataFrame | None = None, translate: C.Translate | None = None,
                 triggers: Sequence[tuple[str, Sequence[str]]] = (),
                 embedder: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, DataFrame]:
    """Chunk, vector, spec, product and family tables of a catalog; ``products`` needs ``ord``."""
    chunk = C.build_documents(products, families, translate, triggers)
    if embedder:
        vector = R.embed_documents(chunk, embedder)
    else:
        vector = chunk.select(F.col("id").alias("chunk_id"), F.lit(None).cast("array<float>").alias("embedding"))
    family = complete(families if families is not None else C.family_rollup(products), FAMILY)
    return {"chunk": chunk, "vector": vector, "spec": normalize_spec(products), "product": products, "family": family}


def search_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables plus postings and corpus statistics, as :func:`partlens.plans.search.hybrid_search` takes them.

    Cards and postings are materialised in the checkpoint folder: a search reads
    them several times, and building a card joins a dozen aggregates.
    """
    chunk = cut_lineage(tables["chunk"])
    rows = cut_lineage(P.index_rows(chunk))
    return {**tables, "chunk": chunk, "posting": rows.filter("term is not null"), "stats": P.corpus_stats(rows)}


def build_index(spark: SparkSession, products_path: str, families_path: str, out: str, **options) -> str:
    """Read a catalog, build its index and write it under ``out``; returns the version folder."""
    products = catalog.read_catalog_jsonl(spark, products_path)
    families = catalog.read_families_csv(spark, families_path)
    return index_store.write_index(index_tables(products, families, **options), out, products_path)
