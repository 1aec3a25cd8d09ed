"""The whole statistics document of a catalog, from small aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import catalog, exclude, graph
from termloom.operators.splits import dead_ids, funnel
from termloom.session import materialize


def statistics(corpus: DataFrame, xrefs: DataFrame, meta: DataFrame, relations: DataFrame) -> dict:
    """Counts, degrees, strata, lengths, keywords and coverage; every part is an aggregate of a few rows."""
    xrefs = materialize(xrefs.select("source", "target", "link_type", "stratum"), "mentions")
    nodes = materialize(graph.universe(corpus), "nodes")
    degrees = materialize(graph.degrees(xrefs, nodes), "degrees")
    one = lambda df: df.first().asDict()
    some = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    edges = graph.directed_edges(xrefs).select(F.col("source").alias("u"), F.col("target").alias("v"))
    dead = dead_ids(meta)
    return {
        "mentions": one(graph.mention_counts(xrefs)),
        "link types": some(xrefs.groupBy("link_type").agg(F.count("*").alias("n")), F.desc("n"), "link_type"),
        "strata": some(graph.stratum_counts(xrefs, nodes), "scope", "stratum"),
        "degrees": some(graph.distribution(degrees, ["out_deg", "in_deg", "und_deg"]), "kind"),
        "nodes": {
            "with_terms": nodes.count(),
            "isolated": degrees.filter("und_deg = 0").count(),
            "dead": dead.count(),
            "edges_touching_dead": graph.touching(edges, dead).count()
        },
        "lengths": one(catalog.length_stats(corpus)),
        "names": one(catalog.name_flags(corpus)),
        "keywords": some(catalog.keyword_counts(meta), "keyword"),
        "relations": one(exclude.relation_sizes(relations)),
        "program coverage": one(catalog.coverage(relations.select(F.col("program").alias("id")), nodes)),
        "funnel": one(funnel(xrefs, corpus, meta)),
    }


def statistics_table(stats: dict, spark) -> DataFrame:
    """(section, item, value) of the document, for queries."""
    rows = []
    for section, body in stats.items():
        for i, part in enumerate(body if isinstance(body, list) else [body]):
            rows += [(section, f"{i:03d}.{k}", None if v is None else str(v)) for k, v in part.items()]
    return spark.createDataFrame(rows, "section string, item string, value string")
