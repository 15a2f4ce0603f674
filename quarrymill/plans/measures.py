"""Queries of aggregates and measures (AGG operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import arrays as ar
from quarrymill.functions import spans as sp
from quarrymill.operators import filters as fl
from quarrymill.operators import measures as op
from quarrymill.operators.ordering import running
from quarrymill.plans.arrays import ITEMS, each_item, items
from quarrymill.plans.filters import TAGGED, tagged
from quarrymill.plans.ordering import UNIT
from quarrymill.plans.registry import query

COUNTS = "count(*)::BIGINT AS documents, sum(len([x for x in v if x >= 0.7]))::BIGINT AS toxic, sum(len([x for x in v if x <= 0.1]))::BIGINT AS clean, sum(len(v) - len([x for x in v if x >= 0.7]) - len([x for x in v if x <= 0.1]))::BIGINT AS neutral, sum((v[-1] < 0.1)::INT)::BIGINT AS ends_clean"


def span_statistics():
    s = F.col("spans")
    toxic, clean = sp.count_where(s, lambda v: v >= 0.7), sp.count_where(s, lambda v: v <= 0.1)
    return [F.count("*").alias("documents"), F.sum(toxic).alias("toxic"), F.sum(clean).alias("clean"), F.sum(F.size(s) - toxic - clean).alias("neutral"), F.count_if(F.get(s, F.size(s) - 1)["score"] < 0.1).alias("ends_clean")]


MIX = "english_score >= 0.5 AND toxic_score >= 0.7 AND len(v) > 1 AND list_max(v) >= 0.7 AND list_min(v) <= 0.1"


@query("agg1_filter_statistics", "toxic_reddit", TAGGED + f"SELECT {COUNTS} FROM u WHERE {MIX}")
def agg1(t):
    return fl.toxic_mix(tagged(t), 0.5, 0.7, 0.1).agg(*span_statistics())


@query("entry_mix_statistics", "toxic_reddit", TAGGED + f", k AS (SELECT *, list_reduce([coalesce(text, '')] || [s.start::VARCHAR || ':' || s.end::VARCHAR for s in list_reverse([s for s in spans if s.score > 0.7])], lambda acc, s: substr(acc, 1, split_part(s, ':', 1)::INT) || substr(acc, split_part(s, ':', 2)::INT + 2)) AS kept FROM u WHERE {MIX}) SELECT source, {COUNTS}, sum(length(kept))::BIGINT AS kept_chars FROM k GROUP BY source")
def entry_mix(t):
    """Mixed records by source: span statistics and the size of what is left after cutting the toxic spans."""
    kept = F.length(sp.excise(F.coalesce("text", F.lit("")), F.col("spans"), 0.7))
    return fl.toxic_mix(tagged(t), 0.5, 0.7, 0.1).groupBy("source").agg(*span_statistics(), F.sum(kept).alias("kept_chars"))


@query("agg2_mask_histogram", "label_mask", "SELECT x AS code, count(*)::BIGINT AS n FROM (SELECT unnest(label_mask) AS x FROM label_mask) GROUP BY x")
def agg2(m):
    return m.select(F.explode("label_mask").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("agg3_token_count", "input_ids", ITEMS + "SELECT count(*)::BIGINT AS items, sum(len(a))::BIGINT AS tokens FROM d")
def agg3(i):
    return each_item(i, n=F.size("a")).agg(F.count("*").alias("items"), F.sum("n").alias("tokens"))


@query("agg4_ngram_counts", "input_ids", ITEMS + "SELECT k, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, gram) AS r FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, gram, count(*)::BIGINT AS n FROM (SELECT unnest([array_to_string(a[j:j + {k - 1}], ' ') for j in range(1, len(a) - {k} + 2)]) AS gram FROM d) GROUP BY gram" for k in (1, 2, 4)) + ")) WHERE r <= 20")
def agg4(i):
    """The most frequent n-grams of each length."""
    a = items(i)
    each = [a.select(F.lit(k).alias("k"), F.explode(F.transform(ar.ngrams(F.col("a"), k), lambda g: F.array_join(g.cast("array<string>"), " "))).alias("gram")) for k in (1, 2, 4)]
    counts = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("k", "gram").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "gram"))).where("r <= 20").drop("r")


@query("agg5_mean_median", "civil_comments", "SELECT round(avg(toxicity), 6) AS mean, round(median(toxicity), 6) AS med, round(avg(exp(toxicity)), 6) AS ppl FROM civil_comments")
def agg5(c):
    one = c.agg(F.round(F.avg("toxicity"), 6).alias("mean"), F.round(F.avg(F.exp("toxicity")), 6).alias("ppl"))
    return one.crossJoin(op.median(c, "toxicity").select(F.round("med", 6).alias("med")))  # one row each


@query("agg6_log_mean_position", "embeddings", "SELECT pos::BIGINT AS pos, round(avg(ln(abs(x::DOUBLE) + 1)), 6) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos")
def agg6(e):
    return e.select(F.posexplode("embedding").alias("p", "x")).groupBy((F.col("p") + 1).cast("bigint").alias("pos")).agg(F.round(F.avg(F.ln(F.abs(F.col("x").cast("double")) + 1)), 6).alias("m"))


@query("agg7_accuracy", "civil_comments", "SELECT round(avg(((toxicity >= 0.5) = (insult >= 0.3))::INT), 6) AS accuracy FROM civil_comments")
def agg7(c):
    return c.agg(F.round(F.avg(((F.col("toxicity") >= 0.5) == (F.col("insult") >= 0.3)).cast("int")), 6).alias("accuracy"))


LOSS = "WITH d AS (SELECT i.item_id, i.a, m.m FROM (SELECT item_id, max(input_ids) AS a FROM input_ids WHERE len(input_ids) > 0 GROUP BY item_id) i JOIN (SELECT item_id, max(label_mask) AS m FROM label_mask WHERE label_mask IS NOT NULL GROUP BY item_id) m ON i.item_id = m.item_id AND len(i.a) = len(m.m)), t AS (SELECT item_id, unnest(a) AS x, unnest(m) AS c, generate_subscripts(a, 1) AS pos FROM d), l AS (SELECT *, (x % 97) / 20.0::DOUBLE AS loss FROM t) "


def losses(i, m):
    """Tokens with a mask code and a stand-in for a loss, made from the token."""
    mask = m.where("label_mask is not null").groupBy("item_id").agg(F.max("label_mask").alias("m"))
    d = items(i).join(mask, "item_id").where(F.size("a") == F.size("m"))
    return d.select("item_id", F.inline(F.arrays_zip(F.col("a").alias("x"), F.col("m").alias("c")))).withColumn("loss", F.col("x") % 97 / 20.0)


@query("agg8_masked_perplexity", "input_ids label_mask", LOSS + "SELECT round(exp(sum(CASE WHEN c = 1 THEN loss ELSE 0 END) / sum((c = 1)::INT)), 4) AS ppl FROM l")
def agg8(i, m):
    return losses(i, m).agg(F.round(F.exp(F.sum(F.when(F.col("c") == 1, F.col("loss")).otherwise(0)) / F.count_if(F.col("c") == 1)), 4).alias("ppl"))


@query("agg9_perplexity_by_code", "input_ids label_mask", LOSS + "SELECT c AS code, round(exp(sum(loss) / count(*)), 4) AS ppl FROM l GROUP BY c")
def agg9(i, m):
    return losses(i, m).groupBy(F.col("c").alias("code")).agg(F.round(F.exp(F.sum("loss") / F.count("*")), 4).alias("ppl"))


@query("agg10_span_token_overlap", "toxic_reddit", TAGGED + """, d AS (SELECT DISTINCT id, text, spans FROM t WHERE text IS NOT NULL AND len(spans) > 0),
 s AS (SELECT id, unnest(spans) AS s FROM d), w AS (SELECT id, unnest(range(0, length(text), 50)) AS b, length(text) AS n FROM d)
 SELECT w.id, count(DISTINCT w.b)::BIGINT AS hot FROM w JOIN s ON s.id = w.id AND s.s.score > 0.7 AND w.b < s.s.end AND least(w.b + 50, w.n) > s.s.start GROUP BY w.id""")
def agg10(t):
    """Pieces of 50 characters that touch a toxic span."""
    one = tagged(t).where(F.col("text").isNotNull() & (F.size("spans") > 0) & (F.length("text") > 0)).withColumn("hot", F.filter("spans", lambda s: s["score"] > 0.7))
    touch = lambda b: F.exists("hot", lambda s: (b < s["end"]) & (F.least(b + 50, F.length("text")) > s["start"]))
    pieces = F.filter(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(50)), touch)
    return one.select("id", pieces.alias("b")).where(F.size("b") > 0).select("id", F.explode("b").alias("b")).groupBy("id").agg(F.count_distinct("b").alias("hot"))


PRED = f"WITH c AS (SELECT DISTINCT comment_id, toxicity FROM civil_comments WHERE toxicity IS NOT NULL), p AS (SELECT comment_id, toxicity >= 0.5 AS y, floor((toxicity + {UNIT.format(k='comment_id')}) * 50) / 100 AS s FROM c) "


def predictions(c):
    """Labels, and scores that a predictor of some skill could give."""
    one = c.where("toxicity is not null").select("comment_id", "toxicity").distinct()
    return one.select("comment_id", (F.col("toxicity") >= 0.5).alias("y"), (F.floor((F.col("toxicity") + ar.hash_unit(F.col("comment_id"))) * 50) / 100).alias("s"))


@query("agg11_binary", "civil_comments", PRED + "SELECT round(avg((y = (s >= 0.5))::INT), 6) AS accuracy, round(sum((y AND s >= 0.5)::INT) / sum((s >= 0.5)::INT), 6) AS precision, round(sum((y AND s >= 0.5)::INT) / sum(y::INT), 6) AS recall, round(2 * sum((y AND s >= 0.5)::INT) / (sum((s >= 0.5)::INT) + sum(y::INT)), 6) AS f1 FROM p")
def agg11(c):
    m = op.binary(F.col("y"), F.col("s") >= 0.5)
    return predictions(c).agg(*[F.round(v, 6).alias(k) for k, v in m.items()])


@query("agg12_roc_auc", "civil_comments", PRED + "SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*), 6)::DOUBLE AS auc FROM p a JOIN p b ON a.y AND NOT b.y")
def agg12(c):
    return op.roc_auc(predictions(c), "y", "s").select(F.round("auc", 6).alias("auc"))


@query("agg13_average_precision", "civil_comments", PRED + ", q AS (SELECT s, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM p GROUP BY s), r AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM q) SELECT round(sum(p * cp / (cp + cn)) / sum(p), 6) AS ap FROM r")
def agg13(c):
    return op.average_precision(predictions(c), "y", "s").select(F.round("ap", 6).alias("ap"))


@query("agg14_mean_sem", "civil_comments", "SELECT k, round(avg(toxicity), 6) AS mean, round(stddev_samp(toxicity) / sqrt(count(toxicity)), 6) AS sem FROM (SELECT comment_id % 5 AS k, toxicity FROM civil_comments) GROUP BY k")
def agg14(c):
    return c.groupBy((F.col("comment_id") % 5).alias("k")).agg(F.round(F.avg("toxicity"), 6).alias("mean"), F.round(F.stddev_samp("toxicity") / F.sqrt(F.count("toxicity")), 6).alias("sem"))


KINDS = ("severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit")


@query("agg16_rollup", "wildguard", "SELECT split, adversarial, count(*)::BIGINT AS n, round(avg((prompt_harm_label = 'harmful')::INT), 6) AS rate FROM wildguard GROUP BY ROLLUP (split, adversarial)")
def agg16(w):
    return w.rollup("split", "adversarial").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prompt_harm_label") == "harmful").cast("int")), 6).alias("rate"))


@query("agg17_thirds", "civil_comments", "WITH r AS (SELECT toxicity, row_number() OVER (ORDER BY comment_id, toxicity) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT comment_id, toxicity FROM civil_comments)) SELECT k // (n // 3) AS block, round(avg(toxicity), 6) AS mean FROM r WHERE k < (n // 3) * 3 GROUP BY 1")
def agg17(c):
    one = c.select("comment_id", "toxicity").distinct()
    third = one.agg(F.floor(F.count("*") / 3).alias("n"))
    r = running(one, F.lit(1), ["comment_id", F.asc_nulls_last("toxicity")], F.floor(F.col("comment_id") / 64), "k").crossJoin(F.broadcast(third))
    return r.where("k < n * 3").groupBy(F.floor(F.col("k") / F.col("n")).alias("block")).agg(F.round(F.avg("toxicity"), 6).alias("mean"))


@query("agg18_channel_accuracy", "civil_comments", "SELECT round(avg((CASE WHEN toxicity >= 0.5 THEN insult > threat ELSE insult <= threat END)::INT), 6) AS accuracy FROM civil_comments WHERE toxicity IS NOT NULL AND insult IS NOT NULL AND threat IS NOT NULL")
def agg18(c):
    right = F.when(F.col("toxicity") >= 0.5, F.col("insult") > F.col("threat")).otherwise(F.col("insult") <= F.col("threat"))
    return c.where("toxicity is not null and insult is not null and threat is not null").agg(F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


@query("agg19_unlikelihood", "input_ids label_mask", LOSS + "SELECT round(-(sum(CASE WHEN c <> 3 THEN -loss ELSE ln(greatest(1 - exp(-loss), 1e-9)) END)) / count(*), 6) AS loss FROM l")
def agg19(i, m):
    term = F.when(F.col("c") != 3, -F.col("loss")).otherwise(F.ln(F.greatest(1 - F.exp(-F.col("loss")), F.lit(1e-9))))
    return losses(i, m).agg(F.round(-F.sum(term) / F.count("*"), 6).alias("loss"))


@query("agg21_group_perplexity", "civil_comments", "SELECT length(text) // 100 AS bin, round(exp(avg(toxicity)), 6) AS ppl FROM civil_comments WHERE text IS NOT NULL GROUP BY 1")
def agg21(c):
    return c.where("text is not null").groupBy(F.floor(F.length("text") / 100).alias("bin")).agg(F.round(F.exp(F.avg("toxicity")), 6).alias("ppl"))


@query("agg22_category_rollup", "supplier nation region", "SELECT r_name, n_name, count(*)::BIGINT AS n, round(avg(s_acctbal), 4) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg22(s, n, r):
    j = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimension tables
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean"))


@query("agg24_weighted_matthews", "civil_comments", PRED + ", q AS (SELECT sum((y AND s >= 0.5)::INT)::DOUBLE AS tp, sum((NOT y AND s >= 0.5)::INT)::DOUBLE AS fp, sum((y AND s < 0.5)::INT)::DOUBLE AS fn, sum((NOT y AND s < 0.5)::INT)::DOUBLE AS tn FROM p) SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM q")
def agg24(c):
    return predictions(c).agg(F.round(op.matthews(F.col("y"), F.col("s") >= 0.5), 6).alias("mcc"))


@query("agg25_all_correct", "lineitem", "SELECT round(avg(ok::INT), 6) AS share FROM (SELECT l_orderkey, bool_and(l_quantity > 10) AS ok FROM lineitem GROUP BY l_orderkey)")
def agg25(x):
    return x.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 10).alias("ok")).agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("share"))


@query("agg28_retrieval", "lineitem", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) SELECT round(avg((r = 1)::INT), 6) AS r1, round(avg((r <= 2)::INT), 6) AS r2, round(avg(1.0::DOUBLE / r), 6) AS mrr FROM r WHERE l_linenumber = 1")
def agg28(x):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    r = x.withColumn("r", F.row_number().over(w)).where("l_linenumber = 1")
    return r.agg(F.round(F.avg((F.col("r") == 1).cast("int")), 6).alias("r1"), F.round(F.avg((F.col("r") <= 2).cast("int")), 6).alias("r2"), F.round(F.avg(1 / F.col("r")), 6).alias("mrr"))


@query("agg29_probability_mass", "lineitem", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN exp(-l_discount) ELSE 0 END) / sum(exp(-l_discount)), 6) AS mass FROM lineitem GROUP BY l_orderkey")
def agg29(x):
    p = F.exp(-F.col("l_discount"))
    return x.groupBy("l_orderkey").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "N", p).otherwise(0)) / F.sum(p), 6).alias("mass"))


@query("agg31_mean_toxicity", "toxic_reddit", "SELECT source, round(avg(toxic_score), 6) AS mean, count(toxic_score)::BIGINT AS n FROM toxic_reddit GROUP BY source")
def agg31(t):
    return t.groupBy("source").agg(F.round(F.avg("toxic_score"), 6).alias("mean"), F.count("toxic_score").alias("n"))


@query("agg32_deviation", "civil_comments", "SELECT round(stddev_pop(toxicity), 6) AS pop, round(stddev_samp(toxicity), 6) AS samp, round(median(toxicity), 6) AS med FROM civil_comments")
def agg32(c):
    one = c.agg(F.round(F.stddev_pop("toxicity"), 6).alias("pop"), F.round(F.stddev_samp("toxicity"), 6).alias("samp"))
    return one.crossJoin(op.median(c, "toxicity").select(F.round("med", 6).alias("med")))  # one row each


@query("agg35_tokens_per_character", "documents", "SELECT lang, round(sum(len(string_split(text, ' ')))::DOUBLE / sum(length(text)), 6) AS ratio FROM documents WHERE length(text) > 0 GROUP BY lang")
def agg35(d):
    return d.where(F.length("text") > 0).groupBy("lang").agg(F.round(F.sum(F.size(F.split("text", " "))).cast("double") / F.sum(F.length("text")), 6).alias("ratio"))
