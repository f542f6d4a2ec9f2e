"""From a question to what answers it: planned searches, seeds, local search, views and the context pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import search
from ..schema import BACKBONE, edge_weight
from ..storage import materialize
from .graph import expand, touching
from .text import TextIndex, diversify


def search_plan(index: TextIndex, nodes: DataFrame, question: str, queries: list[str], limit: int) -> DataFrame:
    """(id, kind, name, score, exact, intent): the nodes that a plan's queries find, best first, `limit` of them.

    Order: exact names of any query, what the question asks for, the score, the id. A node counts once, with its best.
    All hits count: the first by score meet the nodes at once, and of the others only those can come before the last one
    shown whose name or kind stands above its. These are sought among the nodes, and join the hits if there are any.
    """
    terms = _terms(nodes, queries)
    if not terms:
        return nodes.select("id", "kind", "name", F.lit(0.0).alias("score"), F.lit(0).alias("exact"), F.lit(0).alias("intent")).limit(0)
    names = F.array("name", "id")
    exact = F.greatest(*[search.exact_name_boost(names, F.lit(q)) for q in queries], F.lit(0))
    ranks = {"exact": exact, "intent": search.intent_boost(F.lit(question), F.col("kind"))}
    best = lambda rows: rows.select("id", "kind", "name", "score", "exact", "intent").orderBy(F.desc("exact"), F.desc("intent"), F.desc("score"), "id").limit(limit)
    hits, look = index.search(terms).withColumn("score", F.round("score", 6)), max(20, 4 * limit)
    top = materialize(best_nodes(hits, nodes, look).withColumns(ranks), "top")
    shown = best(top)
    if limit <= 0 or top.count() < look:
        return shown
    last = shown.orderBy("exact", "intent").first()
    above = (F.col("exact") > last["exact"]) | ((F.col("exact") == last["exact"]) & (F.col("intent") > last["intent"]))
    higher = nodes.withColumns(ranks).where(above)
    if not higher.limit(1).count():
        return shown
    return best(top.where(~above).select("id", "kind", "name", "score", "exact", "intent").unionByName(higher.join(hits.select("id", "score"), "id").select("id", "kind", "name", "score", "exact", "intent")))


def best_nodes(hits: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """nodes with their score in hits(id, score), a row an id, the first `most` by score and id.

    The first hits alone meet the nodes, which stay where they are. Only if one of those isn't among the nodes (an index that is
    older or of more kinds), all hits are joined.
    """
    first = lambda df: df.orderBy(F.desc("score"), "id").limit(most)
    top = materialize(first(hits.select("id", "score")), "top")
    met = materialize(nodes.join(F.broadcast(top), "id"), "top")  # `most` hits at most
    if top.count() > met.select("id").distinct().count():
        return first(nodes.join(hits.select("id", "score"), "id"))
    return first(met)


def _terms(nodes: DataFrame, texts: list[str]) -> list[str]:
    """The lower-cased terms of all of a plan's texts, 20 a text at most, in one job."""
    rows = nodes.sparkSession.createDataFrame([(t,) for t in texts], "t string")
    return sorted(r["t"] for r in rows.select(F.explode(search.search_terms(F.col("t"), 20)).alias("t")).select(F.lower("t").alias("t")).distinct().collect())


def seeds(first: DataFrame, second: DataFrame | None, queries: int, limit: int = 12) -> DataFrame:
    """The seeds of a question: the first search's nodes; with none of them, or one for three queries and more, both searches' together.

    A node keeps its best score; order by intent, score and id.
    """
    found = first
    if second is not None:
        n = first.limit(2).count()
        if n == 0 or (n == 1 and queries >= 3):
            found = first.unionByName(second)
    best = found.groupBy("id").agg(F.max_by(F.struct("kind", "name", "score", "intent"), F.struct("score", "intent")).alias("x")).select("id", "x.*")
    return best.orderBy(F.desc("intent"), F.desc("score"), "id").limit(limit)


def local_search(edges: DataFrame, found: DataFrame, depth: int = 3, budget: int = 80, per_node: int = 20) -> DataFrame:
    """(id, depth, score): the seeds (id, score) and what lies around them, best first, as the expansion scores it."""
    return expand(edges, found.select("id", "score"), depth, budget, per_node).orderBy(F.desc("score"), "depth", "id")


def chase_backbone(edges: DataFrame, seed: DataFrame, depth: int = 8, budget: int = 60, per_node: int = 8) -> DataFrame:
    """(id, depth, score): as local_search along edges of the heaviest class alone."""
    return expand(edges, seed.select("id", "score"), depth, budget + 1, per_node, types=list(BACKBONE))


def visual_search(hits: DataFrame, nodes: DataFrame, edges: DataFrame, take: int, kinds: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the first `take` nodes of hits (id, score), one row has_more): three times as many are looked at (100 at most), filtered by kind and by edge types that touch them."""
    top = best_nodes(hits, nodes.where(F.col("kind").isin(kinds)) if kinds else nodes, min(100, 3 * take))
    if types:
        top = top.join(touching(edges, top, types), "id", "left_semi")
    return top.orderBy(F.desc("score"), "id").limit(take), top.agg((F.count("*") > take).alias("has_more"))


def agent_search(hits: DataFrame, nodes: DataFrame, query: str, take: int) -> DataFrame:
    """The first `take` nodes of hits (id, score): by exact name, score and id, among four times as many by score."""
    top = best_nodes(hits, nodes, 4 * take)
    return top.withColumn("boost", search.graph_name_boost(F.array("name", "id"), F.lit(query))).orderBy(F.desc("boost"), F.desc("score"), "id").limit(take)


def community_search(hits: DataFrame, tier: str, parent: str | None, limit: int) -> DataFrame:
    """The best hits (id, tier, parent, score) of one tier, below one parent if given."""
    rows = hits.where(F.col("tier") == tier)
    if parent is not None:
        rows = rows.where(F.col("parent") == parent)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def evidence_order(rows: DataFrame, text: str, group: str, order: Column, most: int) -> DataFrame:
    """The first `most` rows by turns of their groups, groups in order of their first row; of texts that are equal but for blanks and case only the first counts."""
    first = rows.withColumn("_o", order).groupBy(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")).alias("_t")).agg(F.min_by(F.struct(*[c for c in rows.columns], "_o"), "_o").alias("x")).select("x.*")
    start = first.groupBy(group).agg(F.min("_o").alias("_s"))
    ranked = first.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy("_o"))).where(F.col("turn") <= most)
    return ranked.join(start, group).orderBy("turn", "_s").limit(most).drop("_s", "_o")


def running_cut(lines: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The lines (in order) up to the first that doesn't fit: each costs its characters and a line end.

    For the lines of one pack, a few thousand at most; the running sum is over one group by nature.
    """
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(w)).where(F.col("used") <= budget)


def context_pack(question: str, found: DataFrame, nodes: DataFrame, edges: DataFrame, within: DataFrame, most: int = 28000, reserve: int = 2000, exact: bool = False, ratio: float = 0.35, ratio_exact: float = 0.55) -> DataFrame:
    """(part, place, line): the pack of a question as numbered lines.

    Parts: 0 the question and its seeds (id, kind, name, score), 1 the relationships among `within`(id), heaviest
    first, up to their share of the characters, 2 their evidence by turns of the edge type, up to the rest.
    """
    spark = nodes.sparkSession
    head = spark.createDataFrame([(question,)], "line string").select(F.lit(0).alias("place"), "line")
    seed_lines = found.select(F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("place"), F.format_string("- [%s] %s (nodeId: %s, score: %s)", "kind", "name", "id", F.round("score", 3).cast("string")).alias("line"))
    top = head.unionByName(seed_lines)
    used = top.agg(F.sum(F.length("line") + 1)).first()[0]
    plan = spark.range(1).select(search.budget_plan(F.lit(max(0, most - reserve - used)), F.lit(exact), ratio, ratio_exact).alias("p")).first()["p"]
    ids = F.broadcast(within.select("id").distinct())
    end = lambda e: nodes.join(ids, "id", "left_semi").select(F.col("id").alias(e), F.col("kind").alias(f"{e}_kind"), F.col("name").alias(f"{e}_name"))
    among = edges.join(F.broadcast(end("src")), "src").join(F.broadcast(end("dst")), "dst")
    said = F.format_string("- [%s] %s (nodeId: %s) -(%s)-> [%s] %s (nodeId: %s)", "src_kind", "src_name", "src", "type", "dst_kind", "dst_name", "dst")
    lines = among.select((-edge_weight(F.col("type"))).alias("w"), "edge_id", "type", said.alias("line"), "occurrence_count")
    links = running_cut(lines, ["w", "edge_id"], plan["structural"]).select(F.row_number().over(W.orderBy("w", "edge_id")).alias("place"), "line")
    proof = lines.select("type", "edge_id", F.concat(F.lit("- "), search.evidence_line(F.col("type"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.concat(F.lit("x"), F.col("occurrence_count").cast("string")))).alias("line"))
    turns = evidence_order(proof, "line", "type", F.col("edge_id"), 40)
    shown = running_cut(turns.select("turn", "type", "line"), ["turn", "type"], plan["evidence"]).select(F.row_number().over(W.orderBy("turn", "type")).alias("place"), "line")
    return top.select(F.lit(0).alias("part"), "place", "line").unionByName(links.select(F.lit(1).alias("part"), "place", "line")).unionByName(shown.select(F.lit(2).alias("part"), "place", "line"))
