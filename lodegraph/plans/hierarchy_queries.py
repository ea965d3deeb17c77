"""Queries of the hierarchy operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import sql_relation
from ..operators import hierarchy
from ..sources.tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.structural_links(table(spark, d, "nodes").select("id"), table(spark, d, "edges").select("source_id", "target_id", "relation"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots_and_depths(_links(spark, d))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(_links(spark, d)).withColumn("steps", F.col("steps").cast("long"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_links(spark, d))


def p4_back_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that close cycles; which link of a cycle it is follows from the walk, so the tests check what must hold of them."""
    return hierarchy.back_links(_links(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_descendants, p4_paths, p4_back_links)}


#: All ancestors with their distances; chains longer than the number of children run in a cycle.
UP_SQL = f"""WITH RECURSIVE l AS (SELECT DISTINCT source_id AS c, target_id AS p FROM edges WHERE {sql_relation('relation')} = 'part_of' AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)),
    lim AS (SELECT count(DISTINCT c) + 1 AS n FROM l), up AS (SELECT c AS node, p AS anc, 1 AS d FROM l UNION SELECT up.node, l.p, d + 1 FROM up JOIN l ON l.c = up.anc WHERE d < (SELECT n FROM lim)),
    cyc AS (SELECT DISTINCT node FROM up WHERE d = (SELECT n FROM lim)), ok AS (SELECT * FROM up WHERE node NOT IN (SELECT node FROM cyc))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"{UP_SQL} SELECT node AS node_id, anc AS root_id, CAST(d AS BIGINT) AS depth FROM ok WHERE anc NOT IN (SELECT c FROM l) UNION ALL SELECT node, 'cycle', -1 FROM cyc",
        "p4_descendants": f"{UP_SQL} SELECT node AS node_id, anc AS ancestor_id, CAST(d AS BIGINT) AS steps FROM ok",
        "p4_paths": f"""{UP_SQL}, pt AS (SELECT c AS node, p AS top, 1 AS d, [p, c] AS path FROM l UNION ALL SELECT pt.node, l.p, d + 1, list_prepend(l.p, path) FROM pt JOIN l ON l.c = pt.top WHERE pt.node NOT IN (SELECT node FROM cyc))
            SELECT node AS node_id, top AS root_id, CAST(d AS BIGINT) AS depth, array_to_string(min(path), '/') AS path FROM pt WHERE node NOT IN (SELECT node FROM cyc) AND top NOT IN (SELECT c FROM l) GROUP BY node, top, d
            UNION ALL SELECT node, 'cycle', -1, NULL FROM cyc UNION ALL SELECT DISTINCT p, p, 0, p FROM l WHERE p NOT IN (SELECT c FROM l)""",
    }
