"""The source/unit graph and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(sources: DataFrame, units: DataFrame) -> DataFrame:
    """Sources and units as nodes with all their fields; what one kind lacks is null, of lists empty. A source's last
    change is its creation."""
    none = F.array().cast("array<string>")
    s = sources.select(F.col("source_id").alias("node_id"), F.lit("source").alias("node_type"), F.col("filename").alias("label"), "source_type", "module_tag", "week_tag", "uploader", none.alias("topic_tags"), none.alias("source_ref"), F.col("created_at").alias("updated_at"))
    u = units.select(F.col("knowledge_id").alias("node_id"), F.lit("knowledge_unit").alias("node_type"), F.col("title").alias("label"), "summary", "module_tag", "week_tag", "approval_status", "pedagogical_role", F.coalesce("topic_tags", none).alias("topic_tags"), F.coalesce("source_ref", none).alias("source_ref"), "updated_at")
    return s.unionByName(u, allowMissingColumns=True)


def ordered(all_nodes: DataFrame) -> DataFrame:
    """Nodes as the graph lists them: sources by creation, then units by their last change, ties by id."""
    return all_nodes.orderBy(F.col("node_type") != "source", "updated_at", "node_id")


def edges(units: DataFrame) -> DataFrame:
    """derived_from edges from every source named to its unit, prerequisite edges between known units; repeats stay."""
    derived = units.select(F.explode("source_ref").alias("source"), F.col("knowledge_id").alias("target"), F.lit("derived_from").alias("edge_type"))
    links = units.select(F.explode("prerequisite_links").alias("source"), F.col("knowledge_id").alias("target"), F.lit("prerequisite").alias("edge_type"))
    known = links.join(units.select(F.col("knowledge_id").alias("source")), "source", "left_semi")
    return derived.unionByName(known.select("source", "target", "edge_type")).withColumn("edge_id", F.concat("edge_type", F.lit(":"), "source", F.lit("->"), "target"))


def neighbours(links: DataFrame) -> DataFrame:
    out = links.select(F.col("source").alias("node_id"), F.col("target").alias("neighbour"))
    return out.unionByName(links.select(F.col("target").alias("node_id"), F.col("source").alias("neighbour"))).where("node_id <> neighbour").distinct()


def passes(module: str = "all", week: str = "all", status: str = "all", role: str = "all", source_type: str = "all") -> Column:
    """Whether a node passes the filters: status and role hold for units, the source type for sources."""
    same = lambda column, wanted: F.lit(True) if wanted == "all" else F.coalesce(F.col(column) == wanted, F.lit(False))
    unit = F.col("node_type") == "knowledge_unit"
    own = F.when(unit, same("approval_status", status) & same("pedagogical_role", role)).otherwise(same("source_type", source_type))
    return same("module_tag", module) & same("week_tag", week) & own


def found(search: str) -> Column:
    """Whether a node's label, id, summary, tags or source type hold the search text."""
    empty = F.lit("")
    said = F.concat_ws(" ", F.coalesce("label", empty), "node_id", F.coalesce("summary", empty), F.coalesce(F.array_join("topic_tags", " "), empty), F.coalesce("source_type", empty))
    return F.lower(said).contains(search.strip().lower())


def visible(all_nodes: DataFrame, links: DataFrame, search: str = "", **filters: str) -> tuple[DataFrame, DataFrame]:
    """(node_id) of the visible nodes, and the edges between them: units that pass filters and search; sources
    that pass the filters and are found themselves or have a visible unit derived from them."""
    judged = all_nodes.where(passes(**filters)).select("node_id", "node_type", found(search).alias("found"))
    units = judged.where("node_type = 'knowledge_unit' and found").select("node_id")
    near = links.where("edge_type = 'derived_from'").join(units.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id"), F.lit(True).alias("near")).distinct()
    sources = judged.where("node_type = 'source'").join(near, "node_id", "left").where("found or near").select("node_id")
    seen = units.unionByName(sources).distinct()
    both = links.join(seen.withColumnRenamed("node_id", "source"), "source", "left_semi").join(seen.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return seen, both


def top_topics(units: DataFrame, most: int = 5) -> DataFrame:
    return units.select(F.explode("topic_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def facets(all_nodes: DataFrame) -> DataFrame:
    """Sorted distinct non-empty values of each facet over all nodes, in one pass."""
    names = ("module_tag", "week_tag", "pedagogical_role", "source_type")
    return all_nodes.agg(*[F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c) for c in names])
