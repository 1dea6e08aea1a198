"""The pN_ queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import token_ids
from framewright.llm.knn import graph_search, neighbour_pairs
from framewright.llm.mixing import draw_mixes
from framewright.llm.mojibake import garbled_documents, restored_documents
from framewright.llm.subjects import document_subjects, fit_tables_scored, subject_composition
from framewright.llm.terms import term_counts
from framewright.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of most similar keyframes."""
    return neighbour_pairs(table(spark, d, "keyframes"))


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar keyframes of the stated query set (every id divisible by 20), by greedy search in the graph."""
    k = table(spark, d, "keyframes")
    return graph_search(k, k.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of every document."""
    documents = table(spark, d, "documents")
    model, scored = fit_tables_scored(table(spark, d, "domains"), table(spark, d, "subject_examples"), table(spark, d, "domain_segments"), documents)
    return document_subjects(documents, model, scored)


def p4_composition(spark: SparkSession, d: str) -> DataFrame:
    """How much of the corpus is about each subject."""
    return subject_composition(p4_found(spark, d), table(spark, d, "documents"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every keyword of the two tables with its counts and mark."""
    return term_counts({
        "domain_segments": (table(spark, d, "domain_segments"), ["analysis_id", "segment_idx"], "keywords", "loaded_at"),
        "scene_domain_map": (table(spark, d, "scene_domain_map"), ["map_id"], "keywords", "loaded_at"),
    })


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The keywords that are too rare or too common."""
    return p5_counts(spark, d).where("term_mark is not null").select("table_name", "term", "term_mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return table(spark, d, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for each mix and how often each is taken."""
    return draw_mixes(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The target and actual share of each source in each mix."""
    return draw_mixes(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a garbled text or passage."""
    return garbled_documents(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their texts restored where possible."""
    return restored_documents(table(spark, d, "documents"))


P5_SQL = r"""
with r as (
  select 'domain_segments' table_name, row_number() over () rid, keywords from (select *, row_number() over (partition by analysis_id, segment_idx order by loaded_at) rn from domain_segments) where rn = 1
  union all
  select 'scene_domain_map', row_number() over (), keywords from (select *, row_number() over (partition by map_id order by loaded_at) rn from scene_domain_map) where rn = 1),
o as (select table_name, rid, trim(regexp_replace(nfc_normalize(lower(nfc_normalize(k))), '[\s\x{A0}]+', ' ', 'g')) term from (select table_name, rid, unnest(keywords) k from r)),
c as (select table_name, term, count(*) occurrences, count(distinct rid) records from o where term <> '' group by 1, 2),
counts as (select table_name, term, occurrences, records, case when records < 3 then 'rare' when records > 0.05 * (select count(*) from r where r.table_name = c.table_name) then 'common' end term_mark from c)
"""

QUERIES = {"p3_found": p3_found, "p3_search": p3_search, "p4_found": p4_found, "p4_composition": p4_composition, "p5_found": p5_found, "p5_counts": p5_counts, "p7_ids": p7_ids, "p8_draws": p8_draws, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored}
SQL = {"p5_counts": P5_SQL + "select * from counts", "p5_found": P5_SQL + "select table_name, term, term_mark from counts where term_mark is not null"}
