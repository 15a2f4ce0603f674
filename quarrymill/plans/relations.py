"""Queries of joins and decontamination (J operators, A3, A4, AGG34, B7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import arrays as ar
from quarrymill.operators import filters as fl
from quarrymill.operators.ordering import assign_ranges, numbered, running
from quarrymill.plans.arrays import ITEMS, each_item
from quarrymill.plans.ordering import ordered
from quarrymill.plans.registry import query

DOCS = "WITH t AS (SELECT DISTINCT id, text FROM toxic_reddit WHERE text IS NOT NULL), g AS (SELECT id, max(toxic_score) AS s FROM toxic_reddit GROUP BY id) "


@query("j1_documents_attributes", "toxic_reddit", DOCS + "SELECT t.id, length(text)::BIGINT AS n, s FROM t JOIN g ON t.id = g.id")
def j1(r):
    docs, attrs = r.where("text is not null").select("id", "text").distinct(), r.groupBy("id").agg(F.max("toxic_score").alias("s"))
    return docs.join(attrs, "id").select("id", F.length("text").cast("bigint").alias("n"), "s")


@query("j1_mismatches", "input_ids label_mask", "WITH a AS (SELECT DISTINCT item_id FROM input_ids), b AS (SELECT DISTINCT item_id FROM label_mask) SELECT CASE WHEN b.item_id IS NULL THEN 'no mask' ELSE 'no ids' END AS kind, count(*)::BIGINT AS n FROM a FULL JOIN b ON a.item_id = b.item_id WHERE a.item_id IS NULL OR b.item_id IS NULL GROUP BY 1")
def j1b(i, m):
    """Ids on one side only are reported, not dropped."""
    a, b = i.select("item_id").distinct().withColumn("a", F.lit(1)), m.select("item_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "item_id", "full").where("a is null or b is null").groupBy(F.when(F.col("b").isNull(), "no mask").otherwise("no ids").alias("kind")).agg(F.count("*").alias("n"))


EV = "WITH e AS (SELECT event_id, user_id, event_type, ts FROM events) "


@query("j2_parent_child", "events", EV + "SELECT event_id, parent FROM (SELECT c.event_id, p.event_id AS parent, row_number() OVER (PARTITION BY c.event_id ORDER BY p.ts DESC, p.event_id DESC) AS r FROM e c JOIN e p ON c.user_id = p.user_id AND p.event_type = 'click' AND c.event_type = 'purchase' AND (p.ts < c.ts OR p.ts = c.ts AND p.event_id < c.event_id)) WHERE r = 1")
def j2(e):
    """The latest parent before each child, as one window instead of a join of all pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    paired = e.withColumn("parent", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return paired.where("event_type = 'purchase' and parent is not null").select("event_id", "parent")


@query("j3_pair_rows", "documents", "SELECT a.doc_id AS parent, b.doc_id AS child FROM (SELECT DISTINCT doc_id FROM documents) a JOIN (SELECT DISTINCT doc_id FROM documents) b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0")
def j3(d):
    one = d.select("doc_id").distinct().withColumn("pair", F.floor(F.col("doc_id") / 2))
    p, c = one.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "parent"), one.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "child")
    return p.join(c, "pair").select("parent", "child")


O2 = "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id::VARCHAR)) - 1 AS pos FROM (SELECT DISTINCT doc_id FROM documents)), b AS (SELECT item_id, row_number() OVER (ORDER BY md5('7:' || item_id::VARCHAR)) - 1 AS pos FROM (SELECT DISTINCT item_id FROM wildguard)) "


@query("j4_positional", "documents wildguard", O2 + "SELECT doc_id, item_id FROM a JOIN b ON a.pos = b.pos")
def j4(d, w):
    a = ordered(d).select("pos", "doc_id")
    b = ordered(w.select(F.col("item_id").alias("doc_id"))).select("pos", F.col("doc_id").alias("item_id"))
    return a.join(b, "pos").select("doc_id", "item_id")


@query("j5_id_lookup", "paradetox", "WITH a AS (SELECT DISTINCT pair_id, split FROM paradetox WHERE split = 'test'), b AS (SELECT DISTINCT pair_id, source FROM paradetox) SELECT a.pair_id, source FROM a JOIN b ON a.pair_id = b.pair_id")
def j5(p):
    return p.where("split = 'test'").select("pair_id").distinct().join(p.select("pair_id", "source").distinct(), "pair_id").select("pair_id", "source")


GRAMS = "[array_to_string(w[k:k + 7], ' ') for k in range(1, len(w) - 6)]"
WORDS = "string_split(lower({}), ' ')"


def grams(df, key, text, n=8):
    w = F.split(F.lower(F.col(text)), " ")
    return df.where(F.col(text).isNotNull()).select(key, w.alias("w")).where(F.size("w") >= n).select(key, F.explode(F.transform(ar.ngrams(F.col("w"), n), lambda g: F.array_join(g, " "))).alias("gram"))


def placed_grams(df, key, text, n=8):
    """grams() with the position of the n-gram's first word."""
    w = F.split(F.lower(F.col(text)), " ")
    return df.where(F.col(text).isNotNull()).select(key, w.alias("w")).where(F.size("w") >= n).select(key, F.posexplode(F.transform(ar.ngrams(F.col("w"), n), lambda g: F.array_join(g, " "))).alias("at", "gram"))


CONT = f"WITH p AS (SELECT item_id, unnest({GRAMS}) AS gram FROM (SELECT item_id, {WORDS.format('prompt')} AS w FROM wildguard WHERE prompt IS NOT NULL) WHERE len(w) >= 8), d AS (SELECT doc_id, unnest({GRAMS}) AS gram FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 8) "


@query("j7_contaminated_items", "wildguard documents", CONT + "SELECT DISTINCT item_id FROM p WHERE gram IN (SELECT gram FROM d)")
def j7(w, d):
    return grams(w, "item_id", "prompt").join(grams(d, "doc_id", "text").select("gram").distinct(), "gram", "left_semi").select("item_id").distinct()


@query("j8_clean_items", "wildguard documents", CONT + "SELECT DISTINCT item_id FROM wildguard WHERE item_id NOT IN (SELECT item_id FROM p WHERE gram IN (SELECT gram FROM d))")
def j8(w, d):
    return w.select("item_id").distinct().join(j7(w, d), "item_id", "left_anti")


@query("a4_ngram_lookup", "wildguard", CONT.split(", d AS")[0] + " SELECT gram, count(DISTINCT item_id)::BIGINT AS n, min(item_id) AS first FROM p GROUP BY gram HAVING count(DISTINCT item_id) > 1")
def a4(w):
    return grams(w, "item_id", "prompt").groupBy("gram").agg(F.count_distinct("item_id").alias("n"), F.min("item_id").alias("first")).where("n > 1")


@query("agg34_ngram_counters", "wildguard documents", CONT + "SELECT count(*)::BIGINT AS total, count(DISTINCT gram)::BIGINT AS uniq, sum((gram IN (SELECT gram FROM p))::INT)::BIGINT AS matching FROM d")
def agg34(w, d):
    p = grams(w, "item_id", "prompt").select("gram").distinct().withColumn("m", F.lit(1))
    counted = grams(d, "doc_id", "text").groupBy("gram").agg(F.count("*").alias("n")).join(p, "gram", "left")
    return counted.agg(F.sum("n").alias("total"), F.count("*").alias("uniq"), F.sum(F.when(F.col("m") == 1, F.col("n")).otherwise(0)).alias("matching"))


@query("a3_hits_per_document", "wildguard documents", CONT + "SELECT doc_id, count(*)::BIGINT AS hits FROM d WHERE gram IN (SELECT gram FROM p) GROUP BY doc_id")
def a3(w, d):
    return grams(d, "doc_id", "text").join(grams(w, "item_id", "prompt").select("gram").distinct(), "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("j9_order_join", "orders lineitem", "SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def j9(o, x):
    per = x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))  # aggregate before the join
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("q"))


@query("j10_demonstration", "wildguard", "WITH s AS (SELECT string_agg(prompt_harm_label, ',' ORDER BY item_id) AS shots FROM (SELECT DISTINCT item_id, prompt_harm_label FROM wildguard WHERE item_id <= 5 AND prompt_harm_label IS NOT NULL)) SELECT DISTINCT item_id, shots || ' -> ' || item_id::VARCHAR AS line FROM wildguard, s WHERE item_id > 5")
def j10(w):
    """Five demonstrations, joined into one row, before every other item."""
    few = w.where("item_id <= 5 and prompt_harm_label is not null").select("item_id", "prompt_harm_label").distinct()
    shots = few.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "prompt_harm_label"))), lambda s: s["prompt_harm_label"]), ",").alias("shots"))
    return w.where("item_id > 5").select("item_id").distinct().crossJoin(F.broadcast(shots)).select("item_id", F.concat("shots", F.lit(" -> "), F.col("item_id").cast("string")).alias("line"))


J11 = ITEMS + ", r AS (SELECT item_id, sum(len(a) // 16) OVER (ORDER BY item_id) AS hi, len(a) // 16 AS n FROM d) SELECT event_id, item_id, (event_id - (hi - n))::BIGINT AS chunk FROM events JOIN r ON event_id >= hi - n AND event_id < hi"


@query("j11_range_assignment", "input_ids events", J11)
def j11(i, e):
    """Every global index that lies in the items' chunks of 16 tokens, with its item and the chunk within it."""
    starts = running(each_item(i, n=F.floor(F.size("a") / 16)), F.col("n"), ["item_id"], F.floor(F.col("item_id") / 256), "lo")
    found = assign_ranges(e.select("event_id"), "event_id", starts.withColumn("hi", F.col("lo") + F.col("n")), "lo", "hi", 64)
    return found.select("event_id", "item_id", (F.col("event_id") - F.col("lo")).alias("chunk"))


@query("j11_every_index", "events", "WITH c AS (SELECT unnest(range(floor(lo / 1000)::BIGINT, floor(hi / 1000)::BIGINT + 1)) AS chunk FROM (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)) SELECT chunk, count(*)::BIGINT AS n FROM events JOIN c ON event_id >= chunk * 1000 AND event_id < (chunk + 1) * 1000 GROUP BY chunk")
def j11_every(e):
    """Ranges of fixed width are a division: every index gets its range."""
    return e.where("event_id is not null").withColumn("chunk", F.floor(F.col("event_id") / 1000)).groupBy("chunk").agg(F.count("*").alias("n"))


@query("b7_few_shot_selection", "wildguard", "WITH w AS (SELECT DISTINCT item_id FROM wildguard), x AS (SELECT a.item_id AS query_id, b.item_id, row_number() OVER (PARTITION BY a.item_id ORDER BY md5(a.item_id::VARCHAR || ':' || b.item_id::VARCHAR)) AS r FROM w a JOIN w b ON a.item_id <> b.item_id WHERE b.item_id <= 40) SELECT query_id, item_id FROM x WHERE r <= 3")
def b7(w):
    """Three demonstrations for each query out of a fixed pool of 40, never the query itself."""
    one = w.select("item_id").distinct()
    pool = one.where("item_id <= 40").agg(F.sort_array(F.collect_set("item_id")).alias("pool"))
    ranked = F.array_sort(F.transform(F.filter("pool", lambda p: p != F.col("query_id")), lambda p: F.struct(F.md5(F.concat_ws(":", "query_id", p)).alias("h"), p.alias("p"))))
    return one.select(F.col("item_id").alias("query_id")).crossJoin(F.broadcast(pool)).select("query_id", F.explode(F.transform(F.slice(ranked, 1, 3), lambda s: s["p"])).alias("item_id"))


PAIRS = "WITH t AS (SELECT DISTINCT id, toxic_score AS x, english_score AS e, row_number() OVER (PARTITION BY id ORDER BY retrieved_at DESC, toxic_score DESC, english_score DESC) AS r FROM toxic_reddit WHERE id IS NOT NULL AND toxic_score IS NOT NULL AND english_score IS NOT NULL), o AS (SELECT id, x, e, row_number() OVER (ORDER BY md5('7:' || id)) - 1 AS pos FROM t WHERE r = 1), p AS (SELECT a.id AS parent, b.id AS child, a.x AS px, b.x AS cx, a.e AS pe, b.e AS ce FROM o a JOIN o b ON b.pos = a.pos + 1 WHERE a.pos % 2 = 0) "


@query("f7_conversation_selection", "toxic_reddit", PAIRS + "SELECT parent, child FROM p WHERE pe >= 0.5 AND ce >= 0.5 AND (px >= 0.7 OR (1 - pe) >= 0.7) AND cx <= 0.3 AND (1 - ce) <= 0.3")
def f7(t):
    """English conversations of a harmful parent and a harmless reply. Records are paired by position in a shuffle, as the
    table has no parents; 1 - english_score stands for the second tagger's score."""
    scored = t.where("id is not null and toxic_score is not null and english_score is not null")
    last = scored.groupBy("id").agg(F.max(F.struct("retrieved_at", F.col("toxic_score").alias("x"), F.col("english_score").alias("e"))).alias("s")).select("id", "s.x", "s.e")
    o = numbered(last, F.md5(F.concat(F.lit("7:"), "id"))).withColumn("pair", F.floor(F.col("pos") / 2))
    side = lambda k, a, b: o.where(F.col("pos") % 2 == k).select("pair", F.col("id").alias(a), F.col("x").alias(b + "_toxic"), (1 - F.col("e")).alias(b + "_nsfw"), F.col("e").alias(b + "_english"))
    return fl.conversations(side(0, "parent", "parent").join(side(1, "child", "child"), "pair"), 0.5, 0.7, 0.3).select("parent", "child")


@query("pr29_parallel_merge", "paradetox", "WITH a AS (SELECT pair_id, max(en_toxic_comment) AS x FROM paradetox WHERE en_toxic_comment IS NOT NULL GROUP BY pair_id), b AS (SELECT pair_id, max(en_neutral_comment) AS y FROM paradetox WHERE en_neutral_comment IS NOT NULL GROUP BY pair_id) SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN 'en: ' || x || chr(10) || 'de: ' || y ELSE 'de: ' || y || chr(10) || 'en: ' || x END AS row_text FROM a JOIN b USING (pair_id)")
def pr29(p):
    """Two parallel corpora joined line by line, and a template that says which side is the source."""
    a = p.where("en_toxic_comment is not null").groupBy("pair_id").agg(F.max("en_toxic_comment").alias("en"))
    b = p.where("en_neutral_comment is not null").groupBy("pair_id").agg(F.max("en_neutral_comment").alias("de"))
    line = lambda k: F.concat(F.lit(k + ": "), F.col(k))
    text = F.when(F.col("pair_id") % 2 == 0, F.concat_ws("\n", line("en"), line("de"))).otherwise(F.concat_ws("\n", line("de"), line("en")))
    return a.join(b, "pair_id").select("pair_id", text.alias("row_text"))


@query("f15_entities", "wildguard documents", "WITH n AS (SELECT DISTINCT split_part(prompt, ' ', 1) || ' ' || split_part(prompt, ' ', 2) AS full_name FROM wildguard WHERE prompt IS NOT NULL), f AS (SELECT DISTINCT unnest([full_name, split_part(full_name, ' ', 1), split_part(full_name, ' ', 2)]) AS name FROM n), w AS (SELECT DISTINCT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id FROM w WHERE w IN (SELECT name FROM f WHERE length(name) > 3)")
def f15(w, d):
    """Documents with a first or last word of any listed two-word name (the whole name implies both)."""
    name = F.slice(F.split("prompt", " "), 1, 2)
    names = w.where("prompt is not null").select(F.explode(name).alias("name")).distinct().where(F.length("name") > 3)
    return fl.mentions_any(d.where("text is not null"), "doc_id", "text", names, "name")
