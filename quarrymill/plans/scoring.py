"""Queries of per-task scoring on long tables of choices (T and B operators, AGG20, AGG27)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.plans.registry import query

CH = "WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS cont, -l_extendedprice / 10000 AS ll, l_quantity AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS k FROM lineitem) "


def choices(x):
    """Line items as choices of a document: a log-likelihood and a length each."""
    return x.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("cont"), (-F.col("l_extendedprice") / 10000).alias("ll"), F.col("l_quantity").alias("n"))


def best(value):
    """The choice with the highest value, the first of equal ones."""
    return -F.max(F.struct(value.alias("v"), (-F.col("cont")).alias("c")))["c"]


@query("t1_argmax", "lineitem", CH + "SELECT round(avg((a = 1)::INT), 6) AS acc, round(avg((b = 1)::INT), 6) AS acc_norm FROM (SELECT doc, arg_max(cont, ll * 1000 - cont * 1e-7) AS a, arg_max(cont, ll / n * 1000 - cont * 1e-7) AS b FROM c GROUP BY doc)")
def t1(x):
    per = choices(x).groupBy("doc").agg(best(F.col("ll")).alias("a"), best(F.col("ll") / F.col("n")).alias("b"))
    return per.agg(F.round(F.avg((F.col("a") == 1).cast("int")), 6).alias("acc"), F.round(F.avg((F.col("b") == 1).cast("int")), 6).alias("acc_norm"))


@query("agg20_choice_metrics", "lineitem", CH + ", f0 AS (SELECT doc, cont, max(ll) AS ll FROM c GROUP BY doc, cont), f AS (SELECT doc, count(*) AS k, arg_max(cont, ll * 1000 - cont * 1e-7) AS a, max(CASE WHEN cont = 2 THEN -ll END) AS ce FROM f0 GROUP BY doc HAVING count(*) >= 3) SELECT k::BIGINT AS k, count(*)::BIGINT AS n, round(avg((a = 2)::INT), 6) AS acc, round(avg(ce), 6) AS ce_loss FROM f GROUP BY k")
def agg20(x):
    per = choices(x).groupBy("doc", "cont").agg(F.max("ll").alias("ll")).groupBy("doc").agg(F.count("*").alias("k"), best(F.col("ll")).alias("a"), F.max(F.when(F.col("cont") == 2, -F.col("ll"))).alias("ce")).where("k >= 3")
    return per.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == 2).cast("int")), 6).alias("acc"), F.round(F.avg("ce"), 6).alias("ce_loss"))


@query("t2_first_larger", "lineitem", CH + "SELECT round(avg((a > b)::INT), 6) AS acc FROM (SELECT doc, max(CASE WHEN cont = 1 THEN ll END) AS a, max(CASE WHEN cont = 2 THEN ll END) AS b FROM c GROUP BY doc) WHERE b IS NOT NULL")
def t2(x):
    per = choices(x).groupBy("doc").agg(F.max(F.when(F.col("cont") == 1, F.col("ll"))).alias("a"), F.max(F.when(F.col("cont") == 2, F.col("ll"))).alias("b")).where("b is not null")
    return per.agg(F.round(F.avg((F.col("a") > F.col("b")).cast("int")), 6).alias("acc"))


@query("t3_greedy_perplexity", "lineitem", CH + "SELECT round(avg((n > 25)::INT), 6) AS greedy, round(exp(-avg(ll)), 4) AS ppl FROM c")
def t3(x):
    return choices(x).agg(F.round(F.avg((F.col("n") > 25).cast("int")), 6).alias("greedy"), F.round(F.exp(-F.avg("ll")), 4).alias("ppl"))


@query("t7_macro_f1", "lineitem", "WITH k AS (SELECT unnest(['A', 'N', 'R']) AS k), x AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p FROM lineitem) SELECT round(avg(f), 6) AS macro_f1 FROM (SELECT k, 2.0::DOUBLE * sum((y = k AND p = k)::INT) / (sum((y = k)::INT) + sum((p = k)::INT)) AS f FROM x, k GROUP BY k)")
def t7(x):
    p = F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 35, "N").otherwise("R")
    one = x.select(F.col("l_returnflag").alias("y"), p.alias("p"))
    f = [2.0 * F.count_if((F.col("y") == k) & (F.col("p") == k)) / (F.count_if(F.col("y") == k) + F.count_if(F.col("p") == k)) for k in "ANR"]
    return one.agg(F.round((f[0] + f[1] + f[2]) / 3, 6).alias("macro_f1"))


@query("t8_question_all", "lineitem", "SELECT l_suppkey, round(avg(ok::INT), 6) AS share FROM (SELECT l_suppkey, l_partkey, bool_and(l_tax < 0.06) AS ok FROM lineitem GROUP BY l_suppkey, l_partkey) GROUP BY l_suppkey")
def t8(x):
    per = x.groupBy("l_suppkey", "l_partkey").agg(F.bool_and(F.col("l_tax") < 0.06).alias("ok"))
    return per.groupBy("l_suppkey").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("share"))


@query("t10_grouped_match", "lineitem", "SELECT round(avg(ok::INT), 6) AS em FROM (SELECT l_orderkey // 4 AS g, bool_and(l_discount < 0.09) AS ok FROM lineitem GROUP BY 1)")
def t10(x):
    per = x.groupBy(F.floor(F.col("l_orderkey") / 4).alias("g")).agg(F.bool_and(F.col("l_discount") < 0.09).alias("ok"))
    return per.agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("em"))


@query("t11_question_f1", "lineitem", "SELECT l_orderkey, sum((l_discount > 0.05 AND l_tax > 0.03)::INT)::BIGINT AS tp, sum((l_discount > 0.05)::INT)::BIGINT AS gold, sum((l_tax > 0.03)::INT)::BIGINT AS pred FROM lineitem GROUP BY l_orderkey")
def t11(x):
    g, p = F.col("l_discount") > 0.05, F.col("l_tax") > 0.03
    return x.groupBy("l_orderkey").agg(F.count_if(g & p).alias("tp"), F.count_if(g).alias("gold"), F.count_if(p).alias("pred"))


@query("b3_windowed_perplexity", "events", "SELECT event_id, round(exp(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 100), 6) AS ppl FROM events WHERE value IS NOT NULL")
def b3(e):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.where("value is not null").select("event_id", F.round(F.exp(F.avg("value").over(w) / 100), 6).alias("ppl"))


@query("b8_instances", "wildguard", "SELECT item_id, CASE prompt_harm_label WHEN 'harmful' THEN 1 WHEN 'unharmful' THEN 0 END AS answer, split || '/' || item_id::VARCHAR AS key FROM wildguard")
def b8(w):
    answers = F.create_map(F.lit("harmful"), F.lit(1), F.lit("unharmful"), F.lit(0))
    return w.select("item_id", F.try_element_at(answers, F.col("prompt_harm_label")).alias("answer"), F.concat_ws("/", "split", "item_id").alias("key"))


@query("st1_running_statistics", "toxic_reddit", "SELECT date_trunc('month', created_at)::TIMESTAMP::VARCHAR AS month, count(*)::BIGINT AS n, sum((toxic_score >= 0.5)::INT)::BIGINT AS toxic FROM toxic_reddit WHERE created_at IS NOT NULL GROUP BY 1")
def st1(t):
    """The batch form of the running statistics; quarrymill.streaming has the incremental one."""
    g = t.where("created_at is not null").groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").cast("string").alias("month"))
    return g.agg(F.count("*").alias("n"), F.sum((F.col("toxic_score") >= 0.5).cast("int")).alias("toxic"))
