"""The register of queries, and what they share: the driver's tables read as the engine's.

Mapping: paragraph, concept, relation and weight are l_orderkey, l_suppkey, l_returnflag and 1 - l_discount of lineitem;
concepts are suppliers, vectors are embeddings. The tables' largest cosines lie below the production thresholds, so the
queries use 0.30 for edges and 0.40 for merges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LABELS = "SELECT l_orderkey AS paragraph, l_suppkey AS concept, l_returnflag AS relation, 1 - l_discount AS weight FROM lineitem"
PC = f"SELECT paragraph, concept, relation, max(weight) AS weight FROM ({LABELS}) GROUP BY ALL"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("paragraph"), F.col("l_suppkey").alias("concept"), F.col("l_returnflag").alias("relation"), (1 - F.col("l_discount")).alias("weight"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.upsert_max(raw_edges(spark, d), ["paragraph", "concept", "relation"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The query: one row by its id."""
    return list(vectors(spark, d).where("id = 0").select("vec").first()[0])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{store.shared_root(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
