"""Queries p8, p9 and p10 over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm import leakage, mixing, residue
from threadloom.llm.registry import SQL, query
from threadloom.sources.tables import load


@query
def p8_found(spark, d):
    return leakage.find_leaks(load(spark, d, "documents"), load(spark, d, "benchmark")).select("doc_id", F.col("item_id").cast("bigint").alias("item_id")).distinct()


@query
def p8_items(spark, d):
    """Every benchmark item with the number of documents that give it away and its longest leak."""
    leaks = leakage.find_leaks(load(spark, d, "documents"), load(spark, d, "benchmark"))
    per_item = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))
    return load(spark, d, "benchmark").select("item_id").join(per_item, "item_id", "left").na.fill(0)


_LEAKS = r"""
with clean as (
  select 'd' as side, doc_id as id, text as t from documents where doc_id is not null and text is not null union all
  select 'i', item_id, text from benchmark where item_id is not null and text is not null),
bare as (
  select side, id, regexp_replace(regexp_replace(regexp_replace(t, '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g'), '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g'), '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g') as t from clean),
words as (select side, id, list_transform(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda x: lower(nfc_normalize(x))) as ws from bare),
wins as (select distinct id as item_id, array_to_string(ws[i : i + 12], '') as w from (select id, ws, unnest(range(1, len(ws) - 11)) as i from words where side = 'i')),
docs as (select id as doc_id, array_to_string(ws, '') as letters, ws from words where side = 'd'),
pos as (
  select doc_id, i, sum(length(word)) over (partition by doc_id order by i) as upto, length(word) as n from (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from docs)),
starts as (select pos.doc_id, (upto - n + 1)::bigint as a, substr(letters, (upto - n + 1)::bigint, 13) as k from pos join docs using (doc_id)),
hits as (select starts.doc_id, item_id, a, w from starts join wins on k = substr(w, 1, 13)),
leaks as (
  select distinct hits.doc_id, hits.item_id
  from hits join docs using (doc_id) join pos on pos.doc_id = hits.doc_id and pos.upto = a - 1 + length(w) where substr(letters, a, length(w)) = w)
"""
SQL["p8_found"] = f"{_LEAKS} select doc_id, item_id from leaks"


@query
def p9_mix(spark, d):
    mixed, _ = mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    return mixed.select("shard", "slot", "source", "block", "pass_no", "n_tokens", "pieces", "tokens")


@query
def p9_shares(spark, d):
    targets = load(spark, d, "mix_targets")
    return mixing.shares(*mixing.mix(load(spark, d, "documents"), targets), targets)


@query
def p10_found(spark, d):
    return residue.found(load(spark, d, "documents"))


@query
def p10_clean(spark, d):
    """The documents that are left once residue is taken out."""
    docs = load(spark, d, "documents")
    return docs.join(residue.found(docs), "doc_id", "left_anti").select("doc_id", "text", "lang", "source")


@query
def p10_validation(spark, d):
    """Counts of right and wrong decisions per source by classifiers that never saw that source."""
    rows = residue.validation(load(spark, d, "documents"))
    return spark.createDataFrame(rows, "host string, true_pos bigint, false_pos bigint, false_neg bigint, true_neg bigint")
