"""Queries of the text-corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from mycelia.llm import encoding, frequency, language, mainbody, packing, residue, scans, sentences, tokenizer
from mycelia.plans.tables import table

QUERIES = {
    "p1_found": lambda spark, d: mainbody.lines_outside(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p1_main_text": lambda spark, d: mainbody.main_texts(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p2_found": lambda spark, d: sentences.sentence_starts(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p4_found": lambda spark, d: language.language_report(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")).drop("confidence"),
    "p4_segments": lambda spark, d: language.language_report(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p5_found": lambda spark, d: scans.lines_to_repair(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p5_paragraphs": lambda spark, d: scans.paragraphs(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p6_found": lambda spark, d: encoding.garbled_records(table(spark, d, "sentence_data"), table(spark, d, "lang_sample")),
    "p6_repaired": lambda spark, d: encoding.repaired_records(table(spark, d, "sentence_data"), encoding.sample_sentences(table(spark, d, "lang_sample"))).distinct(),
    "p7_found": lambda spark, d: frequency.marked_items(table(spark, d, "sentence_data"), table(spark, d, "graph_edge")),
    "p7_counts": lambda spark, d: frequency.all_counts(table(spark, d, "sentence_data"), table(spark, d, "graph_edge")),
    "p8_ids": lambda spark, d: tokenizer.encode_column(table(spark, d, "documents")),
    "p8_round_trip": lambda spark, d: tokenizer.round_trip(table(spark, d, "documents")),
    "p9_windows": lambda spark, d: packing.packed_windows(table(spark, d, "documents"), table(spark, d, "prompt_window")),
    "p9_fill": lambda spark, d: packing.window_fill(packing.packed_windows(table(spark, d, "documents"), table(spark, d, "prompt_window"))),
    "p10_found": lambda spark, d: residue.residue_documents(table(spark, d, "documents")),
}

SQL = {
    "p7_counts": """
WITH r AS (SELECT rec_id, first(list_transform(tokens, lambda t: t.lemma)) AS items FROM sentence_data WHERE len(tokens) > 0 AND rec_id IS NOT NULL GROUP BY 1),
l AS (SELECT rec_id, unnest(items) AS item FROM r),
e AS (SELECT DISTINCT edge_id, repetition_counter FROM graph_edge WHERE repetition_counter IS NOT NULL AND edge_id IS NOT NULL),
c AS (SELECT 'lemma' AS subject, item, count(*) AS occurrences, count(DISTINCT rec_id) AS records, (SELECT count(*) FROM r) AS total FROM l WHERE item IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'repetition_counter', repetition_counter::VARCHAR, count(*), count(*), (SELECT count(*) FROM e) FROM e GROUP BY 2)
SELECT subject, item, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > total * 0.05::DOUBLE THEN 'common' END AS mark FROM c
""",
    "p7_found": """
WITH r AS (SELECT DISTINCT rec_id, list_transform(tokens, lambda t: t.lemma) AS items FROM sentence_data WHERE len(tokens) > 0 AND rec_id IS NOT NULL),
l AS (SELECT rec_id, unnest(items) AS item FROM r),
lc AS (SELECT item, count(DISTINCT rec_id) AS n FROM l WHERE item IS NOT NULL GROUP BY 1),
lt AS (SELECT count(*) AS total FROM r),
e AS (SELECT DISTINCT edge_id, repetition_counter FROM graph_edge WHERE repetition_counter IS NOT NULL AND edge_id IS NOT NULL),
ec AS (SELECT repetition_counter::VARCHAR AS item, count(*) AS n FROM e GROUP BY 1),
et AS (SELECT count(*) AS total FROM e)
SELECT 'lemma' AS subject, item, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark
FROM lc, lt WHERE n < 3 OR n > total * 0.05::DOUBLE
UNION ALL
SELECT 'repetition_counter', item, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END
FROM ec, et WHERE n < 3 OR n > total * 0.05::DOUBLE
"""
}
