"""Queries of graph building, reading, activation and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.functions.dependency import code_to_label, label_to_code
from mycelia.functions.text import DEFAULT_INTENT, INTENTS, STOP_WORDS, intent, not_blank, question_words
from mycelia.operators import activation as A
from mycelia.operators import answers as Q
from mycelia.operators import batches as B
from mycelia.operators import extensions as X
from mycelia.operators import graph as G
from mycelia.plans.tables import once, table
from mycelia.session import cut_lineage

STEPS = 3


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return G.sentences(table(spark, d, "sentence_data"))


def _built(spark: SparkSession, d: str) -> G.Graph:
    return G.build(_sentences(spark, d))


def _stored(spark: SparkSession, d: str) -> G.Graph:
    return G.stored(table(spark, d, "graph_node"), table(spark, d, "graph_edge"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return Q.questions(table(spark, d, "user_question"))


def _spread(spark: SparkSession, d: str, steps: int = STEPS, direction: str = "out") -> tuple[DataFrame, G.Graph]:
    graph = _stored(spark, d)
    return A.spread(Q.question_anchors(_asked(spark, d), graph), A.normalised(graph.edges, direction), steps), graph


def _anchored(spark: SparkSession, d: str) -> tuple[DataFrame, G.Graph]:
    """Anchors, and the stored graph with its edges written once for all that reads them."""
    graph = _stored(spark, d)
    return Q.question_anchors(_asked(spark, d), graph), G.Graph(graph.nodes, B.written(graph.edges))


def _significant(spark: SparkSession, d: str) -> tuple[DataFrame, G.Graph]:
    anchors, graph = _anchored(spark, d)
    return cut_lineage(B.ranked(anchors, graph.edges, STEPS)), graph


def _rounded(df: DataFrame, column: str = "activation", digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


# -- ingest ----------------------------------------------------------------------------------------
def tokens(spark, d):
    return G.exploded_tokens(_sentences(spark, d)).select("sent_id", "tok_idx", "lemma", "dep", "head_offset")


def blank_text_filter(spark, d):
    return table(spark, d, "documents").where(not_blank(F.col("text"))).select("doc_id")


def ingest_status(spark, d):
    rows = once(table(spark, d, "sentence_data").select("rec_id", "elem_type", F.coalesce(F.size("tokens") > 0, F.lit(False)).alias("filled")), "rec_id")
    text = (F.col("elem_type") == "text").cast("long")
    return rows.agg(F.count(F.lit(1)).alias("elements_ingested"), F.sum(text).alias("text_elements"), F.sum(F.when(F.col("filled"), text).otherwise(0)).alias("sentences"))


def dep_codes(spark, d):
    each = G.exploded_tokens(_sentences(spark, d))
    return each.groupBy("dep", label_to_code(F.col("dep")).alias("dep_type")).agg(F.count(F.lit(1)).alias("n"))


def dep_labels(spark, d):
    edges = once(table(spark, d, "graph_edge").select("edge_id", "dep_type"), "edge_id")
    code = F.coalesce("dep_type", F.lit(-1))
    return edges.groupBy(code.alias("dep_type"), code_to_label(code).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def head_status(spark, d):
    head = F.col("tok_idx") + F.col("head_offset")
    kind = F.when(F.coalesce(F.col("head_offset"), F.lit(0)) == 0, "root").when(head.between(0, F.col("n_tokens") - 1), "edge").otherwise("outside")
    return G.exploded_tokens(_sentences(spark, d)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def child_head_join(spark, d):
    return G.sightings(_sentences(spark, d))


def sentence_clock(spark, d):
    return G.clock(_sentences(spark, d))


def node_vocabulary(spark, d):
    return G.vocabulary(_sentences(spark, d))


def edge_upsert(spark, d):
    return _built(spark, d).edges.select("src_id", "dst_id", "dep_type", "repetitions", "last_op", F.round("conductance", 9).alias("conductance"))


def graph_stats(spark, d):
    return G.build_stats(_sentences(spark, d))


def out_degree(spark, d):
    return G.out_degrees(_built(spark, d))


def graph_merge_incremental(spark, d):
    """Two batches of sentences built apart and merged; the ticks of the second follow those of the first."""
    rows = G.ticked(_sentences(spark, d))
    odd = F.col("op_seq") % 2 == 1
    first, second = (G.lemma_edges(rows.where(c)) for c in (odd, ~odd))
    return G.merge_edges(first, second).select("src", "dst", "dep_type", "repetitions", "last_op")


# -- reading ---------------------------------------------------------------------------------------
def stored_edges(spark, d):
    return _rounded(_stored(spark, d).edges.select("src_id", "dst_id", "dep_type", "repetitions", "last_op", "conductance"), "conductance", 9)


def edge_weight_share(spark, d):
    return _rounded(G.weight_shares(_stored(spark, d).edges), "weight", 9)


def lemma_lookup(spark, d):
    words = _asked(spark, d).select(F.explode(question_words(F.col("query"))).alias("lemma")).distinct()
    return G.node_ids(words, _stored(spark, d).nodes)


def id_lookup(spark, d):
    ids = table(spark, d, "graph_edge").where("to_node_id IS NOT NULL").select(F.col("to_node_id").alias("node_id")).distinct()
    return G.lemmas_of(ids, _stored(spark, d).nodes)


# -- activation ------------------------------------------------------------------------------------
def intent_classify(spark, d):
    return _asked(spark, d).select("query_id", intent(F.col("query")).alias("intent"))


def anchor_resolution(spark, d):
    return Q.question_anchors(_asked(spark, d), _stored(spark, d))


def spread_step_1(spark, d):
    return _rounded(_spread(spark, d, 1)[0])


def spread_3(spark, d):
    anchors, graph = _anchored(spark, d)
    return _rounded(B.spread_all(anchors, graph.edges, STEPS))


def spread_2_bidirectional(spark, d):
    anchors, graph = _anchored(spark, d)
    return _rounded(B.spread_all(anchors, graph.edges, 2, "both"))


def active_nodes(spark, d):
    anchors, graph = _anchored(spark, d)
    return B.counted(anchors, graph.edges, STEPS)


def significant_nodes(spark, d):
    return _significant(spark, d)[0]


def significant_nodes_compat(spark, d):
    anchors, graph = _anchored(spark, d)
    return B.padded(cut_lineage(B.ranked(anchors, graph.edges, STEPS)), B.counted(anchors, graph.edges, STEPS))


def top_k_activated(spark, d):
    anchors, graph = _anchored(spark, d)
    return B.ranked(anchors, graph.edges, STEPS, 5)


def induced_subgraph(spark, d):
    kept, graph = _significant(spark, d)
    return _rounded(B.linked(kept, graph.edges).drop("rn", "first_seen"), "conductance", 9)


def induced_subgraph_compat(spark, d):
    """The compatible subgraph of every 20th question: an edge is emitted once per place of its source, here with the number of places."""
    graph = _stored(spark, d)
    anchors, edges = Q.question_anchors(_asked(spark, d).where("query_id % 20 = 0"), graph), B.written(graph.edges)
    kept = cut_lineage(B.ranked(anchors, edges, STEPS))
    padded = B.padding(kept, B.counted(anchors, edges, STEPS)).select("query_id", F.lit(0).cast("long").alias("node_id"), (F.col("active") - F.col("cut")).alias("n"))
    each = kept.select("query_id", "node_id", F.lit(1).cast("long").alias("n")).unionAll(padded)
    places = each.groupBy("query_id", "node_id").agg(F.sum("n").cast("int").alias("rn"))  # equal places are counted before they are joined
    return B.linked(places, edges).select("query_id", "from_id", "to_id", "dep_type", F.col("rn").alias("places"))


def capped_edges(spark, d):
    kept, graph = _significant(spark, d)
    return _rounded(A.capped(B.linked(kept, graph.edges), 10).drop("rn", "first_seen"), "conductance", 9)


def merge_nodes(spark, d):
    """The nodes of the odd sentences, then those the even ones add, numbered on."""
    rows = G.ticked(_sentences(spark, d))
    each = rows.where("op_seq % 2 = 0").select("op_seq", F.posexplode("tokens").alias("tok_idx", "t")).where("t.lemma IS NOT NULL")
    lemmas = each.select("t.lemma", (F.col("op_seq") * F.lit(1 << 20) + F.col("tok_idx")).alias("first_seen"))
    return G.merge_nodes(G.vocabulary(rows.where("op_seq % 2 = 1")), lemmas)


def element_types(spark, d):
    rows = once(table(spark, d, "sentence_data").select("rec_id", "elem_type", (F.col("elem_type") == "text").alias("kept")), "rec_id")
    return rows.groupBy("elem_type", "kept").agg(F.count(F.lit(1)).alias("n"))


def anchor_dedup(spark, d):
    """Words of a question that name a node, and the distinct anchors they give."""
    graph, asked = _stored(spark, d), _asked(spark, d)
    words = asked.select("query_id", F.explode(F.split(F.lower("query"), "[^\\p{L}\\p{M}\\p{N}’'-]+")).alias("lemma")).join(graph.nodes, "lemma")
    return words.groupBy("query_id").agg(F.count(F.lit(1)).alias("words"), F.count_distinct("node_id").alias("anchors"))


def fact_corroboration(spark, d):
    """How many drop folders bear a fact out."""
    rows = once(table(spark, d, "sentence_data").where("elem_type = 'text' AND size(tokens) > 0").select(F.col("rec_id").alias("sent_id"), "tokens", "source"), "sent_id")
    return X.corroborated(G.sightings(rows, "source"), ["src", "dst", "dep_type"], "source")


def graph_quality(spark, d):
    return X.quality(_stored(spark, d))


def render_context(spark, d):
    kept, graph = _significant(spark, d)
    return Q.contexts(kept, B.linked(kept, graph.edges), graph.nodes)


def render_answer(spark, d):
    return Q.run_queries(_stored(spark, d), _asked(spark, d), STEPS)


QUERIES = {
    f.__name__: f
    for f in (
        tokens, blank_text_filter, ingest_status, dep_codes, dep_labels, head_status, child_head_join, sentence_clock, node_vocabulary, edge_upsert,
        graph_stats, out_degree, graph_merge_incremental, stored_edges, edge_weight_share, lemma_lookup, id_lookup, intent_classify, anchor_resolution,
        merge_nodes, element_types, anchor_dedup, fact_corroboration, graph_quality, induced_subgraph_compat, capped_edges, spread_step_1, spread_3, spread_2_bidirectional, active_nodes, significant_nodes, significant_nodes_compat, top_k_activated, induced_subgraph,
        render_context, render_answer,
    )
}

# -- SQL -------------------------------------------------------------------------------------------
def _quoted(text: str) -> str:
    """A text as an SQL literal; line ends as expressions."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


_G = "list_reduce(list_transform(range({n}), lambda x: 0.1::DOUBLE), lambda g, i: g + 0.1::DOUBLE / (1 + g))"
_S = """s AS (SELECT rec_id AS sent_id, first(tokens) AS tokens FROM sentence_data
  WHERE elem_type = 'text' AND len(tokens) > 0 AND rec_id IS NOT NULL GROUP BY 1),
t AS (SELECT sent_id, tokens, len(tokens)::INT AS n_tokens, (generate_subscripts(tokens, 1) - 1)::INT AS tok_idx, unnest(tokens) AS t FROM s)"""
_SIGHT = f"""{_S},
si AS (SELECT sent_id, tok_idx, t.lemma AS src, tokens[tok_idx + t.head_offset + 1].lemma AS dst, coalesce(dep_code, 0) AS dep_type
  FROM t LEFT JOIN dep_label ON dep_name = t.dep
  WHERE t.head_offset <> 0 AND tok_idx + t.head_offset BETWEEN 0 AND n_tokens - 1),
sg AS (SELECT * FROM si WHERE src IS NOT NULL AND dst IS NOT NULL),
clk AS (SELECT sent_id, row_number() OVER (ORDER BY sent_id) AS op_seq FROM s),
fst AS (SELECT t.lemma AS lemma, min((sent_id, tok_idx)) AS first_at FROM t WHERE t.lemma IS NOT NULL GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY first_at) - 1 AS node_id, lemma FROM fst),
le AS (SELECT src, dst, dep_type, count(*) AS repetitions, max(op_seq) AS last_op FROM sg JOIN clk USING (sent_id) GROUP BY ALL),
e AS (SELECT a.node_id AS src_id, b.node_id AS dst_id, dep_type, repetitions, last_op, {_G.format(n="repetitions")} AS conductance
  FROM le JOIN n a ON a.lemma = src JOIN n b ON b.lemma = dst)"""
_STORED = """n AS (SELECT node_id, first(lemma) AS lemma FROM graph_node WHERE node_id IS NOT NULL GROUP BY 1),
er AS (SELECT DISTINCT edge_id, from_node_id, to_node_id, coalesce(dep_type, 0) AS dep_type, greatest(coalesce(repetition_counter, 1), 1) AS r,
  last_activated_op_count AS op, coalesce(conductance, 0.1) AS g FROM graph_edge WHERE to_node_id >= 0),
e AS (SELECT from_node_id AS src_id, to_node_id AS dst_id, dep_type, sum(r)::BIGINT AS repetitions, max(op) AS last_op, min(edge_id) AS first_seen,
  arg_max(g, coalesce(op, -1) * 1000000000000 + edge_id) AS conductance FROM er GROUP BY ALL)"""
_ASKED = f"""q AS (SELECT query_id, first(query_text) AS query FROM user_question WHERE query_text IS NOT NULL GROUP BY 1),
w0 AS (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{M}}\\p{{N}}’''-]+')) AS lemma FROM q),
w AS (SELECT DISTINCT * FROM w0 WHERE length(lemma) >= 3 AND lemma NOT IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))"""


def _spread_sql(steps: int, both: bool = False) -> str:
    pool = "(SELECT src_id, dst_id, conductance FROM e" + (" UNION ALL SELECT dst_id, src_id, conductance FROM e)" if both else ")")
    parts = [
        _STORED,
        _ASKED,
        "an AS (SELECT DISTINCT query_id, node_id FROM w JOIN n USING (lemma))",
        f"tot AS (SELECT src_id, sum(conductance) AS total FROM {pool} GROUP BY 1)",
        f"wt AS (SELECT p.src_id, p.dst_id, sum(p.conductance / total) AS weight FROM {pool} p JOIN tot USING (src_id) GROUP BY 1, 2)",
        "a0 AS (SELECT query_id, node_id, 1.0::DOUBLE AS activation FROM an)",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""a{k} AS (SELECT query_id, node_id, sum(x) AS activation FROM (
  SELECT query_id, node_id, activation * 0.5 AS x FROM a{k - 1}
  UNION ALL SELECT query_id, dst_id, activation * weight FROM a{k - 1} JOIN wt ON src_id = node_id
  UNION ALL SELECT query_id, node_id, 0.5 FROM an) GROUP BY 1, 2)"""
        )
    return ",\n".join(parts)


_CUT = f"""{_spread_sql(STEPS)},
rk AS (SELECT query_id, node_id, round(activation, 9) AS a, row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 9) DESC, node_id) AS rn
  FROM a{STEPS} WHERE activation > 1e-6),
gp AS (SELECT *, round(a - lead(a) OVER (PARTITION BY query_id ORDER BY rn), 9) AS gap FROM rk),
ct AS (SELECT query_id, min(rn) AS cut FROM gp JOIN (SELECT query_id, max(gap) AS best FROM gp GROUP BY 1) b USING (query_id) WHERE gap = best GROUP BY 1),
sn AS (SELECT query_id, node_id, a AS activation, rn FROM rk LEFT JOIN ct USING (query_id) WHERE cut IS NULL OR rn <= cut)"""
_PADDED = f"""{_CUT},
cn AS (SELECT query_id, count(*) AS n, max(cut) AS cut FROM rk LEFT JOIN ct USING (query_id) GROUP BY 1),
sp AS (SELECT query_id, node_id, activation, rn FROM sn UNION ALL
  SELECT query_id, 0, 0.0, unnest(range(cut + 1, n + 1)) FROM cn WHERE cut IS NOT NULL AND cut < n)"""
_SUB = """sub AS (SELECT x.query_id, src_id AS from_id, dst_id AS to_id, dep_type, conductance, x.rn, first_seen
  FROM e JOIN {src} x ON x.node_id = src_id JOIN (SELECT DISTINCT query_id, node_id FROM {src}) y ON y.query_id = x.query_id AND y.node_id = dst_id)"""
_LINES = f"""{_CUT}, {_SUB.format(src="sn")},
ls AS (SELECT query_id, string_agg(coalesce(lemma, 'unknown'), ', ' ORDER BY rn) AS concepts FROM sn LEFT JOIN n USING (node_id) GROUP BY 1),
ln AS (SELECT query_id, string_agg('- ''' || coalesce(a.lemma, 'unknown') || ''' --(' || coalesce(dep_name, 'UNKNOWN') || ', strength:' || printf('%.2f', conductance) || ')--> ''' || coalesce(b.lemma, 'unknown') || '''' || chr(10), '' ORDER BY rn, first_seen) AS lines
  FROM sub LEFT JOIN n a ON a.node_id = from_id LEFT JOIN n b ON b.node_id = to_id LEFT JOIN dep_label ON dep_code = dep_type GROUP BY 1),
cx AS (SELECT query_id, CASE WHEN lines IS NOT NULL THEN {_quoted(Q.RELATIONS_HEAD)} || lines ELSE {_quoted(Q.CONCEPTS_HEAD)} || concepts END AS context
  FROM ls LEFT JOIN ln USING (query_id))"""
_INTENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'starts_with(lower(query), {_quoted(o)})' for o in openings)} THEN '{name}'" for name, openings in INTENTS) + f" ELSE '{DEFAULT_INTENT}' END"

SQL = {
    "tokens": f"WITH {_S} SELECT sent_id, tok_idx, t.lemma AS lemma, t.dep AS dep, t.head_offset AS head_offset FROM t",
    "blank_text_filter": "SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\\s\\p{Z}]')",
    "ingest_status": """WITH r AS (SELECT rec_id, first(elem_type) AS k, first(coalesce(len(tokens), 0) > 0) AS f FROM sentence_data WHERE rec_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS elements_ingested, count(*) FILTER (k = 'text') AS text_elements, count(*) FILTER (k = 'text' AND f) AS sentences FROM r""",
    "dep_codes": f"WITH {_S} SELECT t.dep AS dep, coalesce(dep_code, 0) AS dep_type, count(*) AS n FROM t LEFT JOIN dep_label ON dep_name = t.dep GROUP BY 1, 2",
    "dep_labels": """WITH x AS (SELECT DISTINCT edge_id, coalesce(dep_type, -1) AS dep_type FROM graph_edge WHERE edge_id IS NOT NULL)
SELECT dep_type, coalesce(dep_name, 'UNKNOWN') AS label, count(*) AS n FROM x LEFT JOIN dep_label ON dep_code = dep_type GROUP BY 1, 2""",
    "head_status": f"""WITH {_S} SELECT CASE WHEN coalesce(t.head_offset, 0) = 0 THEN 'root' WHEN tok_idx + t.head_offset BETWEEN 0 AND n_tokens - 1 THEN 'edge' ELSE 'outside' END AS kind,
 count(*) AS n FROM t GROUP BY 1""",
    "child_head_join": f"WITH {_SIGHT} SELECT * FROM sg",
    "sentence_clock": f"WITH {_SIGHT} SELECT * FROM clk",
    "node_vocabulary": f"WITH {_SIGHT} SELECT * FROM n",
    "edge_upsert": f"WITH {_SIGHT} SELECT src_id, dst_id, dep_type, repetitions, last_op, round(conductance, 9) AS conductance FROM e",
    "graph_stats": f"WITH {_SIGHT} SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS total_edge_count",
    "out_degree": f"WITH {_SIGHT}, o AS (SELECT src_id, count(*) AS c FROM e GROUP BY 1) SELECT node_id, coalesce(c, 0) AS out_degree FROM n LEFT JOIN o ON src_id = node_id",
    "graph_merge_incremental": f"WITH {_SIGHT} SELECT * FROM le",
    "stored_edges": f"WITH {_STORED} SELECT src_id, dst_id, dep_type, repetitions, last_op, round(conductance, 9) AS conductance FROM e",
    "edge_weight_share": f"WITH {_STORED} SELECT src_id, dst_id, dep_type, round(conductance / sum(conductance) OVER (PARTITION BY src_id), 9) AS weight FROM e",
    "lemma_lookup": f"WITH {_STORED}, {_ASKED}, d AS (SELECT DISTINCT lemma FROM w) SELECT lemma, coalesce(node_id, -1) AS node_id FROM d LEFT JOIN n USING (lemma)",
    "id_lookup": f"WITH {_STORED}, i AS (SELECT DISTINCT to_node_id AS node_id FROM graph_edge WHERE to_node_id IS NOT NULL) SELECT node_id, lemma FROM i LEFT JOIN n USING (node_id)",
    "intent_classify": f"WITH {_ASKED} SELECT query_id, {_INTENT} AS intent FROM q",
    "anchor_resolution": f"WITH {_spread_sql(0)} SELECT * FROM an",
    "spread_step_1": f"WITH {_spread_sql(1)} SELECT query_id, node_id, round(activation, 6) AS activation FROM a1",
    "spread_3": f"WITH {_spread_sql(3)} SELECT query_id, node_id, round(activation, 6) AS activation FROM a3",
    "spread_2_bidirectional": f"WITH {_spread_sql(2, True)} SELECT query_id, node_id, round(activation, 6) AS activation FROM a2",
    "active_nodes": f"WITH {_spread_sql(3)} SELECT query_id, count(*) AS active FROM a3 WHERE activation > 1e-6 GROUP BY 1",
    "significant_nodes": f"WITH {_CUT} SELECT query_id, node_id, activation, rn::INT AS rn FROM sn",
    "significant_nodes_compat": f"WITH {_PADDED} SELECT query_id, node_id, activation, rn::INT AS rn FROM sp",
    "top_k_activated": f"WITH {_CUT} SELECT query_id, node_id, a AS activation, rn::INT AS rn FROM rk WHERE rn <= 5",
    "induced_subgraph": f"WITH {_CUT}, {_SUB.format(src='sn')} SELECT query_id, from_id, to_id, dep_type, round(conductance, 9) AS conductance FROM sub",
    "induced_subgraph_compat": f"""WITH {_PADDED.replace("FROM q)", "FROM q WHERE query_id % 20 = 0)")}, pl AS (SELECT query_id, node_id, count(*)::INT AS places FROM sp GROUP BY 1, 2)
SELECT x.query_id, src_id AS from_id, dst_id AS to_id, dep_type, x.places AS places FROM e JOIN pl x ON x.node_id = src_id JOIN pl y ON y.query_id = x.query_id AND y.node_id = dst_id""",
    "capped_edges": f"""WITH {_CUT}, {_SUB.format(src="sn")}, ck AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn, first_seen) AS k FROM sub)
SELECT query_id, from_id, to_id, dep_type, round(conductance, 9) AS conductance FROM ck WHERE k <= 10""",
    "merge_nodes": f"""WITH {_SIGHT}, o AS (SELECT t.lemma AS lemma, min((sent_id, tok_idx)) AS first_at FROM t JOIN clk USING (sent_id) WHERE op_seq % 2 = 1 AND t.lemma IS NOT NULL GROUP BY 1),
w AS (SELECT t.lemma AS lemma, min((op_seq, tok_idx)) AS first_at FROM t JOIN clk USING (sent_id) WHERE op_seq % 2 = 0 AND t.lemma IS NOT NULL AND t.lemma NOT IN (SELECT lemma FROM o) GROUP BY 1)
SELECT row_number() OVER (ORDER BY first_at) - 1 AS node_id, lemma FROM o UNION ALL SELECT (SELECT count(*) FROM o) + row_number() OVER (ORDER BY first_at) - 1, lemma FROM w""",
    "element_types": """WITH r AS (SELECT rec_id, first(elem_type) AS elem_type FROM sentence_data WHERE rec_id IS NOT NULL GROUP BY 1)
SELECT elem_type, elem_type = 'text' AS kept, count(*) AS n FROM r GROUP BY 1, 2""",
    "anchor_dedup": f"WITH {_STORED}, {_ASKED} SELECT query_id, count(*) AS words, count(DISTINCT node_id) AS anchors FROM w0 JOIN n USING (lemma) GROUP BY 1",
    "fact_corroboration": f"""WITH {_SIGHT}, src AS (SELECT rec_id AS sent_id, first(source) AS source FROM sentence_data WHERE elem_type = 'text' AND len(tokens) > 0 AND rec_id IS NOT NULL GROUP BY 1)
SELECT src, dst, dep_type, count(*) AS sightings, count(DISTINCT source) AS sources FROM sg JOIN src USING (sent_id) GROUP BY 1, 2, 3""",
    "graph_quality": f"""WITH {_STORED}, ends AS (SELECT src_id AS node_id FROM e UNION SELECT dst_id FROM e), pairs AS (SELECT DISTINCT src_id, dst_id FROM e)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n ANTI JOIN ends USING (node_id)) AS isolated,
 (SELECT count(*) FROM pairs WHERE src_id = dst_id) AS loops, (SELECT count(*) FROM pairs a JOIN pairs b ON a.src_id = b.dst_id AND a.dst_id = b.src_id WHERE a.src_id < a.dst_id) AS mutual,
 (SELECT count(*) FROM ends ANTI JOIN n USING (node_id)) AS dangling""",
    "render_context": f"WITH {_LINES} SELECT * FROM cx",
    "render_answer": f"""WITH {_LINES} SELECT query_id, query, {_INTENT} AS intent,
 CASE WHEN context IS NULL THEN {_quoted(Q.NOTHING_FOUND)} ELSE {_quoted(Q.INSTRUCTION + Q.CONTEXT_HEAD)} || context || {_quoted(chr(10) + Q.QUERY_HEAD + "'")} || query || {_quoted("'" + chr(10) * 2 + Q.ANSWER_TAIL)} END AS answer
FROM q LEFT JOIN cx USING (query_id)""",
}
