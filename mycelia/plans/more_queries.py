"""Queries of sources and of the documented capabilities, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mycelia.functions.text import question_words
from mycelia.operators import answers as Q
from mycelia.operators import extensions as X
from mycelia.operators import graph as G
from mycelia.plans.graph_queries import _ASKED, _STORED
from mycelia.plans.tables import once, table
from mycelia.sources import files

FACTS = "SELECT 'c' || c_custkey AS src, 'part_of' AS relation, 'n' || c_nationkey AS dst, 'a' AS source FROM customer UNION ALL SELECT 's' || s_suppkey, 'part_of', 'n' || s_nationkey, 'a' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, 'b' FROM nation"


def _facts(spark, d):
    part = lambda t, key, to, a, b, source: table(spark, d, t).select(F.concat(F.lit(a), key).alias("src"), F.lit("part_of").alias("relation"), F.concat(F.lit(b), to).alias("dst"), F.lit(source).alias("source"))
    return part("customer", "c_custkey", "c_nationkey", "c", "n", "a").unionByName(part("supplier", "s_suppkey", "s_nationkey", "s", "n", "a")).unionByName(part("nation", "n_nationkey", "n_regionkey", "n", "r", "b"))


def reader_dispatch(spark, d):
    events = once(table(spark, d, "file_event").select("event_id", "file_path"), "event_id")
    return events.groupBy(files.reader_of(F.col("file_path")).alias("reader")).agg(F.count(F.lit(1)).alias("n"))


def archive_state(spark, d):
    return files.archive_state(table(spark, d, "file_event"))


def files_without_record(spark, d):
    paths = table(spark, d, "file_event").where("file_path IS NOT NULL").select("file_path").distinct()
    return paths.join(table(spark, d, "sentence_data").select("file_path").distinct(), "file_path", "left_anti")


def page_text_extract(spark, d):
    pages = table(spark, d, "documents").where("lower(file_path) LIKE '%.html' AND text IS NOT NULL")
    page = F.concat(F.lit("<html><style>p {}</style><h1>Note</h1><p>"), "text", F.lit("</p><script>x()</script></html>"))
    return pages.select("doc_id", files.html_text(page).alias("text"))


def built_in_tokens(spark, d):
    text = table(spark, d, "documents").select("doc_id", F.explode(files.built_in_sentences(F.col("text"))).alias("s"))
    return text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size("s.tokens")).alias("tokens"))


def rule_closure(spark, d):
    return X.closure(_facts(spark, d), ["part_of"])


def emergent_facts(spark, d):
    return X.emergence(_facts(spark, d), ["part_of"])


def edge_history(spark, d):
    rows = once(table(spark, d, "graph_edge").where("to_node_id >= 0").select("edge_id", "from_node_id", F.coalesce("dep_type", F.lit(0)).alias("dep_type"), "to_node_id", "seen_at"), "edge_id")
    return X.history(rows, ["from_node_id", "dep_type"], "to_node_id", "seen_at", "edge_id")


def vector_recall(spark, d):
    rows = table(spark, d, "embeddings")
    return X.nearest(rows, rows.where("vec_id % 20 = 0"), 5)


def learning_levels(spark, d):
    return X.levels(_facts(spark, d).select("src", "dst"))


def graph_entropy(spark, d):
    return X.relation_entropy(G.stored(table(spark, d, "graph_node"), table(spark, d, "graph_edge")).edges)


def canonical_nodes(spark, d):
    return X.canonical(once(table(spark, d, "graph_node").select("node_id", "lemma"), "node_id"))


def topic_route(spark, d):
    words = Q.questions(table(spark, d, "user_question")).select("query_id", F.explode(question_words(F.col("query"))).alias("lemma"))
    rows = table(spark, d, "sentence_data").where("elem_type = 'text' AND source IS NOT NULL").select("source", F.explode("tokens.lemma").alias("lemma"))
    return X.routed(words, rows.select(F.col("source").alias("topic"), "lemma"))


QUERIES = {
    f.__name__: f
    for f in (reader_dispatch, archive_state, files_without_record, page_text_extract, built_in_tokens, rule_closure, emergent_facts, edge_history, vector_recall, learning_levels, graph_entropy, canonical_nodes, topic_route)
}

SQL = {
    "reader_dispatch": """WITH e AS (SELECT DISTINCT event_id, file_path FROM file_event WHERE event_id IS NOT NULL)
SELECT CASE WHEN lower(file_path) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_path) LIKE '%.html' THEN 'html' ELSE 'auto' END AS reader, count(*) AS n FROM e GROUP BY 1""",
    "archive_state": """WITH r AS (SELECT file_path, archived, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC, event_id DESC) AS k FROM file_event WHERE file_path IS NOT NULL AND event_id IS NOT NULL)
SELECT file_path, archived FROM r WHERE k = 1""",
    "files_without_record": "SELECT DISTINCT file_path FROM file_event f WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sentence_data s WHERE s.file_path = f.file_path)",
    "built_in_tokens": """WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, len(list_filter(regexp_split_to_array(s, '[ ,;:\\t\\r]+'), lambda w: length(w) > 0)) AS n FROM p WHERE regexp_matches(s, '[^\\s\\p{Z},;:]'))
SELECT doc_id, count(*) AS sentences, sum(n)::BIGINT AS tokens FROM k GROUP BY 1""",
    "rule_closure": f"""WITH RECURSIVE f AS ({FACTS}), c(src, relation, dst, depth) AS (SELECT DISTINCT src, relation, dst, 0 FROM f
 UNION SELECT c.src, c.relation, f.dst, depth + 1 FROM c JOIN f ON f.src = c.dst) SELECT src, relation, dst, min(depth)::INT AS depth FROM c GROUP BY 1, 2, 3""",
    "emergent_facts": f"""WITH RECURSIVE f AS ({FACTS}), c(src, relation, dst) AS (SELECT src, relation, dst FROM f UNION SELECT c.src, c.relation, f.dst FROM c JOIN f ON f.src = c.dst),
o(src, relation, dst, source) AS (SELECT src, relation, dst, source FROM f UNION SELECT o.src, o.relation, f.dst, o.source FROM o JOIN f ON f.src = o.dst AND f.source = o.source)
SELECT src, relation, dst FROM c EXCEPT SELECT src, relation, dst FROM o""",
    "edge_history": """WITH e AS (SELECT DISTINCT edge_id, from_node_id, coalesce(dep_type, 0) AS dep_type, to_node_id, seen_at FROM graph_edge WHERE to_node_id >= 0 AND edge_id IS NOT NULL),
c AS (SELECT *, lag(to_node_id) OVER w AS p FROM e WINDOW w AS (PARTITION BY from_node_id, dep_type ORDER BY seen_at, edge_id))
SELECT from_node_id, dep_type, to_node_id, seen_at AS valid_from, lead(seen_at) OVER (PARTITION BY from_node_id, dep_type ORDER BY seen_at, edge_id) AS valid_to FROM c WHERE p IS NULL OR p <> to_node_id""",
    "vector_recall": """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.v, r.v), 6) AS score
 FROM x q, x r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank::INT AS rank FROM k WHERE rank <= 5""",
    "learning_levels": f"""WITH RECURSIVE f AS ({FACTS}), l(node, level) AS (SELECT DISTINCT dst, 0 FROM f WHERE dst NOT IN (SELECT src FROM f) UNION SELECT f.src, level + 1 FROM l JOIN f ON f.dst = node)
SELECT node, max(level)::INT AS level FROM l GROUP BY 1""",
    "page_text_extract": """WITH p AS (SELECT doc_id, '<html><style>p {}</style><h1>Note</h1><p>' || text || '</p><script>x()</script></html>' AS h FROM documents WHERE lower(file_path) LIKE '%.html' AND text IS NOT NULL)
SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'),
 '(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM p""",
    "graph_entropy": f"""WITH {_STORED}, p AS (SELECT dep_type, count(*) AS n FROM e GROUP BY 1) SELECT count(*) AS relations, round(-sum(n / t * ln(n / t)), 9) AS entropy FROM p, (SELECT sum(n)::DOUBLE AS t FROM p)""",
    "canonical_nodes": "WITH n AS (SELECT node_id, first(lemma) AS lemma FROM graph_node WHERE node_id IS NOT NULL GROUP BY 1) SELECT node_id, min(node_id) OVER (PARTITION BY lower(lemma)) AS canonical_id FROM n WHERE lemma IS NOT NULL",
    "topic_route": f"""WITH {_ASKED}, tw AS (SELECT DISTINCT source AS topic, t.lemma AS lemma FROM (SELECT source, unnest(tokens) AS t FROM sentence_data WHERE elem_type = 'text' AND source IS NOT NULL)),
m AS (SELECT query_id, topic, count(*) AS overlap FROM w JOIN tw USING (lemma) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, topic) AS rank FROM m)
SELECT query_id, topic, overlap, rank::INT AS rank FROM k WHERE rank <= 3""",
}
