"""Graphs as bundles on disk: Parquet or JSON tables with a manifest, and pages as markdown with front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import schema as S

VERSION = 1


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """Write nodes, edges and a manifest; an existing bundle is replaced."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").format(form).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(form).save(f"{path}/edges")
    spark.createDataFrame([(VERSION, form)], "version int, form string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a bundle. A bundle of another version is refused."""
    head = spark.read.schema("version int, form string").json(f"{path}/manifest").first()
    if head is None or head.version != VERSION:
        raise ValueError(f"bundle {path!r} has version {head.version if head else None}; this reads {VERSION}")
    read = lambda name, schema: spark.read.schema(schema).format(head.form).load(f"{path}/{name}")
    return read("nodes", S.NODE_SCHEMA), read("edges", S.EDGE_SCHEMA)


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown) of pages with page_id, title, wiki_id and content: front matter, heading, text."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("title", F.lit("")), '"', "'"), F.lit('"'))
    head = F.concat(F.lit("---\ntitle: "), quoted, F.lit("\nwiki: "), F.coalesce("wiki_id", F.lit("")), F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"))
    return pages.select("page_id", F.concat(head, F.coalesce("content", F.lit(""))).alias("markdown"))
