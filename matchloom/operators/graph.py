"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.storage import discard, written

def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of an edge table (src, dst): the smallest vertex that can be reached.

    Each round gives the smallest component among a vertex's neighbours to the vertex and to its current component, so
    that whole trees are hooked and not single vertices, and then takes the component's own (pointer jumping). The
    rounds grow with the log of the longest path and go on until nothing moves. Labels are written after each round;
    minima over edges combine on the map side, and joins read written tables, so that adaptive execution can split hot
    vertices. Edges with a null end are left out.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    state = written(both.groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("m")).select("vertex", F.least("vertex", "m").alias("component"), F.lit(True).alias("moved")), "components")
    while True:
        low = both.join(state.select(F.col("vertex").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("component").alias("low"))
        seen = state.drop("moved").join(low, "vertex", "left")
        roots = seen.where("low < component").groupBy(F.col("component").alias("vertex")).agg(F.min("low").alias("root_low"))
        jump = state.select(F.col("vertex").alias("via"), F.col("component").alias("beyond"))
        step = seen.join(roots, "vertex", "left").withColumn("via", F.least("component", "low", "root_low")).join(jump, "via", "left")
        best = F.least("via", F.coalesce("beyond", "via"))
        new = written(step.select("vertex", best.alias("component"), (best != F.col("component")).alias("moved")), "components")
        discard(state)
        state = new
        if not state.where("moved").limit(1).count():
            discard(both)
            found = state.drop("moved")
            found._matchloom_path = state._matchloom_path
            return found


def bipartite(rows: DataFrame) -> DataFrame:
    """Components of the graph of usable documents and pairs, with documents per side and pairs in each."""
    named = written(rows.where("usable").select(F.concat(F.lit("resume:"), "resume_hash").alias("src"), F.concat(F.lit("jd:"), "jd_hash").alias("dst")).distinct(), "pair-edges")
    vertices = named.select(F.col("src").alias("name")).union(named.select("dst")).distinct()
    numbered = written(vertices.select(F.monotonically_increasing_id().alias("vertex"), "name"), "numbered-vertices")  # rounds shuffle numbers
    at = lambda end: numbered.select(F.col("name").alias(end), F.col("vertex").alias(f"{end}_number"))
    used = written(named.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst")), "numbered-edges")
    discard(named)
    found = components(used)
    members = found.withColumnRenamed("component", "number").join(numbered, "vertex")
    sides = members.groupBy("number").agg(F.min("name").alias("component"), F.count_if(F.col("name").startswith("resume:")).alias("n_resumes"), F.count_if(F.col("name").startswith("jd:")).alias("n_jds"))
    pairs = used.join(found, used.src == found.vertex).groupBy(F.col("component").alias("number")).agg(F.count(F.lit(1)).alias("n_pairs"))
    return sides.join(pairs, "number").drop("number")
