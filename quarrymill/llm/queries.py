"""The queries of the training-data problems, by name; all run over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.leaks import leaked_items
from quarrymill.llm.near_duplicates import near_duplicate_pairs, near_duplicate_report
from quarrymill.llm.abuse import Model, abuse_rates, abuse_scores, abusive_records, fitted
from quarrymill.llm.encoding import encode_texts
from quarrymill.llm.mixing import margin_report, mix_report, mixed_documents
from quarrymill.llm.packing import CAPACITY, packed_sequences, packing_report, paired_items, placed_pieces
from quarrymill.llm.pii import mentions, redact
from quarrymill.llm.residue import residue_documents, residue_templates
from quarrymill.llm.split_overlap import cross_split_overlaps, overlap_report
from quarrymill.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "toxic_reddit"), "id", "text")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_report(table(spark, d, "toxic_reddit"), "id", "text")


def p1_leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "wildguard")
    each = [leaked_items(table(spark, d, t), k, "text", items, "item_id", "prompt").withColumn("corpus", F.lit(t)) for t, k in (("documents", "doc_id"), ("toxic_reddit", "id"))]
    return each[0].unionByName(each[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_leaks(spark, d).where("stretch >= need").select("corpus", "doc_key", "item_id")


def p2_packed(spark: SparkSession, d: str) -> DataFrame:
    return packed_sequences(table(spark, d, "input_ids"), table(spark, d, "label_mask"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Of each item: into how many pieces it is cut, their tokens, the longest, and in how many bins the item lies."""
    sizes = paired_items(table(spark, d, "input_ids"), table(spark, d, "label_mask")).select("item_id", F.size("ids").alias("n"))
    pieces = placed_pieces(sizes)
    return pieces.groupBy("item_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"), F.max("length").cast("bigint").alias("longest"), F.count_distinct("bin_id").alias("bins"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums over all sequences: tokens, ids, and products of ids and masks, which tell whether a mask stays with its ids; sequences over the capacity."""
    packed = p2_packed(spark, d)
    both = F.aggregate(F.zip_with("input_ids", "label_mask", lambda x, m: x.cast("bigint") * m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    ids = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return packed.agg(F.sum("used").alias("tokens"), F.sum(ids).alias("id_sum"), F.sum(both).alias("masked_sum"), F.count_if((F.col("used") > CAPACITY) | (F.size("label_mask") != F.col("used"))).alias("wrong"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(table(spark, d, "input_ids"))


_models: dict[tuple[str, str], Model] = {}


def _abuse_model(spark: SparkSession, d: str) -> Model:
    """The model of a folder's tables, fitted once a session and shared by the queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _models:
        _models[key] = fitted(table(spark, d, "toxic_reddit"), table(spark, d, "paradetox"))
    return _models[key]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return abusive_records(table(spark, d, "toxic_reddit"), model=_abuse_model(spark, d))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "toxic_reddit"), model=_abuse_model(spark, d))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(table(spark, d, "toxic_reddit"), model=_abuse_model(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    each = [mentions(table(spark, d, t), "id", "text").select(F.lit(t).alias("corpus"), "doc_key", "pii_type", "start_pos") for t in ("toxic_reddit", "non_toxic_reddit")]
    return each[0].unionByName(each[1])


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    each = [redact(table(spark, d, t), "id", "text").withColumn("corpus", F.lit(t)) for t in ("toxic_reddit", "non_toxic_reddit")]
    return each[0].unionByName(each[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlaps(*[table(spark, d, t) for t in ("unseen_data", "non_toxic_reddit", "paradetox")]).select("dataset", "eval_key", "train_key")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(*[table(spark, d, t) for t in ("unseen_data", "non_toxic_reddit", "paradetox")])


def p5_unseen(spark: SparkSession, d: str) -> DataFrame:
    """The part of p5_found that SQL can say: records of at least 40 words with half of their three-word runs in common."""
    return p5_found(spark, d).where("dataset = 'unseen_data'").select("eval_key", "train_key")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_margins(spark: SparkSession, d: str) -> DataFrame:
    return margin_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(spark, d, "documents"), "doc_id", "text")


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    return residue_templates(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_residue(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_leaks, p2_packed, p2_pieces, p2_totals, p2_report, p3_found, p3_scores, p3_rates, p4_found, p4_redacted, p5_found, p5_unseen, p5_report, p6_found, p6_groups, p7_ids, p8_mix, p8_report, p8_margins, p9_found, p9_residue, p9_templates)
    return {f.__name__: f for f in every}


_SPACE = r"[\p{Z}\s\x{0b}\x{1c}-\x{1f}\x{85}]+"
_WORDS = "[w for w in regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{Z}\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}]+', '', 'g'), '" + _SPACE + "') if w <> '']"
#: Distinct three-word runs of the records of at least 40 words of a table.
_RUNS = "(SELECT id, unnest(list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)])) AS g, len(list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)])) AS n FROM (SELECT DISTINCT id, " + _WORDS + " AS w FROM {t} WHERE id IS NOT NULL AND text IS NOT NULL) WHERE len(w) >= 40)"
_ITEMS = "WITH i AS (SELECT item_id, max(input_ids) AS a FROM input_ids WHERE item_id IS NOT NULL AND len(input_ids) > 0 GROUP BY item_id), k AS (SELECT item_id, max(label_mask) AS m FROM label_mask WHERE item_id IS NOT NULL AND label_mask IS NOT NULL GROUP BY item_id), p AS (SELECT item_id, a, [coalesce(m[x], 1) for x in range(1, len(a) + 1)] AS m FROM i LEFT JOIN k USING (item_id)) "


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can say over the whole tables: pairs by shared runs, and the sums and pieces that any packing keeps."""
    return {
        "p2_pieces": _ITEMS + "SELECT item_id, ceil(len(a) / 2048.0)::BIGINT AS pieces, len(a)::BIGINT AS tokens, least(len(a), 2048)::BIGINT AS longest, ceil(len(a) / 2048.0)::BIGINT AS bins FROM p",
        "p2_totals": _ITEMS + "SELECT sum(len(a))::BIGINT AS tokens, sum(list_sum(a))::BIGINT AS id_sum, sum(list_sum([a[x]::BIGINT * m[x] for x in range(1, len(a) + 1)]))::BIGINT AS masked_sum, 0::BIGINT AS wrong FROM p",
        "p5_unseen": f"WITH a AS {_RUNS.replace('{t}', 'unseen_data')}, b AS {_RUNS.replace('{t}', 'non_toxic_reddit')} SELECT a.id AS eval_key, b.id AS train_key FROM a JOIN b USING (g) GROUP BY a.id, b.id HAVING 2 * count(*) >= max(a.n) + max(b.n) - count(*)",
        "p6_found": f"WITH a AS {_RUNS.replace('{t}', 'toxic_reddit')} SELECT x.id AS id_a, y.id AS id_b FROM a x JOIN a y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id HAVING 2 * count(*) >= max(x.n) + max(y.n) - count(*)",
    }
