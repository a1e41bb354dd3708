"""Questions to grounded prompts, a whole table at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mycelia.functions.dependency import code_to_label
from mycelia.functions.text import intent, question_words
from mycelia.operators.activation import anchors_of, capped, subgraph
from mycelia.operators.batches import counted, linked, padded, ranked, written
from mycelia.operators.graph import Graph
from mycelia.plans.tables import once
from mycelia.session import cut_lineage

# Wording of the prompt. Fixed values.
NOTHING_FOUND = "i could not find relevant information."
INSTRUCTION = "based on the following structured knowledge, answer the user's query.\ndo not use any external knowledge.\n\n"
CONTEXT_HEAD = "=== knowledge graph context ===\n"
QUERY_HEAD = "=== user query ===\n"
ANSWER_TAIL = "answer:"
RELATIONS_HEAD = "key concepts and their relations:\n"
CONCEPTS_HEAD = "key concepts: "


def questions(user_question: DataFrame) -> DataFrame:
    """``query_id, query``: one row per question; null questions are left out, empty ones stay."""
    return once(user_question.where("query_text IS NOT NULL").select("query_id", F.col("query_text").alias("query")), "query_id")


def question_anchors(asked: DataFrame, graph: Graph) -> DataFrame:
    words = asked.select("query_id", F.explode(question_words(F.col("query"))).alias("lemma"))
    return anchors_of(words, graph.nodes)


def edge_line(src: Column, label: Column, strength: Column, dst: Column) -> Column:
    return F.concat(F.lit("- '"), src, F.lit("' --("), label, F.lit(", strength:"), F.format_string("%.2f", strength), F.lit(")--> '"), dst, F.lit("'\n"))


def contexts(nodes: DataFrame, edges: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``query_id, context``: the lines of each question's edges, or the list of its concepts if it has none."""
    named = nodes.join(lemmas, "node_id", "left").withColumn("lemma", F.coalesce("lemma", F.lit("unknown")))
    concepts = named.groupBy("query_id", "node_id").agg(F.min("rn").alias("rn"), F.first("lemma").alias("lemma"))
    listed = concepts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "lemma"))), lambda x: x.lemma), ", ").alias("concepts"))
    name = concepts.select("query_id", "node_id", "lemma")
    lined = (
        edges.join(name.select("query_id", F.col("node_id").alias("from_id"), F.col("lemma").alias("src")), ["query_id", "from_id"], "left")
        .join(name.select("query_id", F.col("node_id").alias("to_id"), F.col("lemma").alias("dst")), ["query_id", "to_id"], "left")
        .withColumn("line", edge_line(F.coalesce("src", F.lit("unknown")), code_to_label(F.col("dep_type")), F.col("conductance"), F.coalesce("dst", F.lit("unknown"))))
    )
    drawn = lined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "first_seen", "line"))), lambda x: x.line), "").alias("lines"))
    text = F.when(F.col("lines").isNotNull(), F.concat(F.lit(RELATIONS_HEAD), "lines")).otherwise(F.concat(F.lit(CONCEPTS_HEAD), "concepts"))
    return listed.join(drawn, "query_id", "left").select("query_id", text.alias("context"))


def answers(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, query, intent, answer`` of every question; those without context get the fixed apology."""
    prompt = F.concat(F.lit(INSTRUCTION + CONTEXT_HEAD), "context", F.lit("\n" + QUERY_HEAD + "'"), "query", F.lit("'\n\n" + ANSWER_TAIL))
    text = F.when(F.col("context").isNull(), NOTHING_FOUND).otherwise(prompt)
    return asked.join(found, "query_id", "left").select("query_id", "query", intent(F.col("query")).alias("intent"), text.alias("answer"))


def run_queries(graph: Graph, asked: DataFrame, steps: int = 3, direction: str = "out", compat: bool = False) -> DataFrame:
    """The whole cycle for a batch of questions (``query_id, query``): anchors, spread, cut, subgraph, prompt.

    ``compat`` pads the significant nodes with node 0 and lets it emit its edges once per repetition, up to as many edges
    as the graph has.
    """
    anchors, stored = question_anchors(asked, graph), written(graph.edges)
    kept = ranked(anchors, stored, steps, direction=direction)
    if compat:
        kept = padded(cut_lineage(kept), counted(anchors, stored, steps, direction))
    kept = cut_lineage(kept)
    edges = capped(subgraph(kept, stored), stored.count()) if compat else linked(kept, stored)
    return answers(asked, contexts(kept, edges, graph.nodes))
