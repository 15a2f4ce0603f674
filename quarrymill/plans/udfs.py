"""Queries of operators that SQL can't say."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import sequential as op
from quarrymill.plans.arrays import each_item
from quarrymill.plans.registry import query
from quarrymill.plans.relations import grams, placed_grams


@query("f19_periodic", "input_ids")
def f19(i):
    return each_item(i, periodic=op.periodic(F.col("a"), times=4))


@query("x9_linear_probe", "embeddings")
def x9(e):
    return op.linear_probe(e, "embedding", F.col("label") == 0, steps=8)


@query("a10_bag_alignment", "paradetox")
def a10(p):
    """Comma-separated parts of both comments as answers."""
    some = p.where("en_toxic_comment is not null and en_neutral_comment is not null")
    return some.select("pair_id", op.bag_scores(F.split("en_toxic_comment", ","), F.split("en_neutral_comment", ",")).alias("s")).select("pair_id", "s.em", "s.f1")


@query("a3_clean_chunks", "wildguard documents")
def a3_chunks(w, d):
    """Texts without the surroundings of every n-gram of the prompts in them (those that a3_hits_per_document counts)."""
    own = d.where("text is not null").select("doc_id", "text", F.md5("text").alias("digest"))
    hits = placed_grams(own, "digest", "text").join(grams(w, "item_id", "prompt").select("gram").distinct(), "gram", "left_semi").groupBy("digest").agg(F.collect_set("at").alias("at"))
    spans = op.word_spans(F.col("text"), F.col("at"), 8)
    return own.join(hits, "digest", "left").select("doc_id", F.size(op.decontaminated(F.col("text"), spans)).alias("slices"))
