"""Queries of order, sampling, splits, packing and windows (L, W, S, U, SNK operators)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import arrays as ar
from quarrymill.operators import ordering as op
from quarrymill.operators import tokens as tk
from quarrymill.plans.arrays import EOS, ITEMS, each_item, items
from quarrymill.plans.registry import query
from quarrymill.sources import sinks

POS = "WITH d AS (SELECT DISTINCT doc_id FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{s}:' || doc_id::VARCHAR)) - 1 AS pos, (SELECT count(*) FROM d) AS n FROM d) "
POS7 = POS.format(s=7)


def ordered(d, seed=7):
    """Documents with their position in a seeded shuffle, and the number of all."""
    ids = d.select("doc_id").distinct()
    return op.numbered(ids, op.hash_order(F.col("doc_id"), seed)).crossJoin(F.broadcast(ids.agg(F.count("*").alias("n"))))


@query("l1_shuffle", "documents", POS7 + "SELECT doc_id, pos FROM o")
def l1(d):
    return ordered(d).select("doc_id", "pos")


@query("l2_head_share", "documents", POS7 + "SELECT doc_id FROM o WHERE pos < n * 3 // 10")
def l2(d):
    return ordered(d).where("pos < floor(n * 3 / 10)").select("doc_id")


@query("l3_partition", "documents", POS7 + "SELECT doc_id, pos // (n // 5) AS part FROM o WHERE pos < (n // 5) * 5")
def l3(d):
    return ordered(d).withColumn("size", F.floor(F.col("n") / 5)).where("pos < size * 5").select("doc_id", F.floor(F.col("pos") / F.col("size")).alias("part"))


@query("l4_train_test", "documents", POS7 + "SELECT doc_id, CASE WHEN pos >= n - n // 10 THEN 'test' ELSE 'train' END AS part FROM o")
def l4(d):
    return ordered(d).select("doc_id", F.when(F.col("pos") >= F.col("n") - F.floor(F.col("n") / 10), "test").otherwise("train").alias("part"))


@query("l5_named_parts", "documents", POS7 + "SELECT doc_id, CASE WHEN pos < 100 THEN 'probe' WHEN pos < 350 THEN 'dev' ELSE 'rest' END AS part FROM o")
def l5(d):
    return ordered(d).select("doc_id", F.when(F.col("pos") < 100, "probe").when(F.col("pos") < 350, "dev").otherwise("rest").alias("part"))


@query("l6_proportional", "documents", POS7 + ", p AS (SELECT *, round(n * 0.949)::BIGINT AS a, round(n * 0.949)::BIGINT + round(n * 0.05)::BIGINT AS b FROM o) SELECT CASE WHEN pos < a THEN 0 WHEN pos < b THEN 1 ELSE 2 END AS part, count(*)::BIGINT AS n FROM p GROUP BY 1")
def l6(d):
    a = F.round(F.col("n") * 0.949).cast("bigint")
    b = a + F.round(F.col("n") * 0.05).cast("bigint")
    return ordered(d).select(F.when(F.col("pos") < a, 0).when(F.col("pos") < b, 1).otherwise(2).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


BAL = "WITH w AS (SELECT DISTINCT item_id, prompt_harm_label AS label FROM wildguard WHERE prompt_harm_label IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || item_id::VARCHAR)) AS k FROM w) "


@query("l7_balanced", "wildguard", BAL + "SELECT item_id, label FROM r WHERE k <= 20")
def l7(w):
    one = w.where("prompt_harm_label is not null").select("item_id", F.col("prompt_harm_label").alias("label")).distinct()
    return op.balanced(one, "label", "item_id", 20, 3).select("item_id", "label")


@query("l8_by_predicate", "civil_comments", "WITH c AS (SELECT DISTINCT comment_id, toxicity, insult FROM civil_comments) SELECT 'toxic' AS kind, comment_id FROM (SELECT * FROM c WHERE toxicity >= 0.5 ORDER BY md5('1:' || comment_id::VARCHAR) LIMIT 25) UNION ALL SELECT 'insult', comment_id FROM (SELECT * FROM c WHERE insult >= 0.3 ORDER BY md5('1:' || comment_id::VARCHAR) LIMIT 25)")
def l8(c):
    one = c.select("comment_id", "toxicity", "insult").distinct()
    parts = [one.where(test).orderBy(op.hash_order(F.col("comment_id"), 1)).limit(25).select(F.lit(kind).alias("kind"), "comment_id") for kind, test in (("toxic", "toxicity >= 0.5"), ("insult", "insult >= 0.3"))]
    return parts[0].unionByName(parts[1])


@query("l9_size_preserving_merge", "documents", POS7 + ", i AS (SELECT doc_id, pos FROM o WHERE pos < 300) SELECT doc_id, 'base' AS origin, CASE WHEN pos >= n - 50 THEN 'test' ELSE 'train' END AS part FROM o WHERE pos >= 300 UNION ALL SELECT doc_id, 'insert', 'train' FROM i")
def l9(d):
    """Inserted rows take the place of as many base rows; the test set is the end of the base."""
    o = ordered(d)
    base = o.where("pos >= 300").select("doc_id", F.lit("base").alias("origin"), F.when(F.col("pos") >= F.col("n") - 50, "test").otherwise("train").alias("part"))
    return base.unionByName(o.where("pos < 300").select("doc_id", F.lit("insert").alias("origin"), F.lit("train").alias("part")))


@query("l11_pad_world", "documents", POS7 + ", t AS (SELECT ((n + 6) // 7) * 7 AS total, n FROM o LIMIT 1), s AS (SELECT unnest(range(total::BIGINT)) AS g, n FROM t) SELECT s.g, o.doc_id FROM s JOIN o ON o.pos = s.g % s.n")
def l11(d):
    """The order wrapped around to a multiple of the world size."""
    o = ordered(d)
    total = o.agg(F.max("n").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / 7) * 7 - 1)).alias("g"))
    return total.join(o.select("pos", "doc_id"), F.col("g") % F.col("n") == F.col("pos")).select("g", "doc_id")


@query("l12_rank_slice", "documents", POS7 + "SELECT doc_id, (pos - 12) // 4 AS step FROM o WHERE pos >= 12 AND (pos - 12) % 4 = 1")
def l12(d):
    return ordered(d).where("pos >= 12 and (pos - 12) % 4 = 1").select("doc_id", F.floor((F.col("pos") - 12) / 4).alias("step"))


@query("l13_batches", "documents", POS7 + "SELECT doc_id, pos // 32 AS batch, (pos % 32) // 8 AS worker FROM o WHERE pos < (n // 32) * 32")
def l13(d):
    return ordered(d).where("pos < floor(n / 32) * 32").select("doc_id", F.floor(F.col("pos") / 32).alias("batch"), F.floor(F.col("pos") % 32 / 8).alias("worker"))


UNIT = "(('0x' || substr(md5({k}::VARCHAR), 1, 8))::UBIGINT / 4294967296)"


@query("l14_rate_repeat", "documents", f"SELECT doc_id, k FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN (SELECT unnest(range(1, 4)) AS k) WHERE {UNIT.format(k='doc_id')} < 0.4")
def l14(d):
    some = d.select("doc_id").distinct().where(ar.hash_unit(F.col("doc_id")) < 0.4)
    return some.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))


@query("l15_epoch_orders", "documents", "WITH d AS (SELECT DISTINCT doc_id FROM documents), e AS (SELECT doc_id, unnest(range((2500 + (SELECT count(*) FROM d) - 1) // (SELECT count(*) FROM d))) AS epoch FROM d) SELECT epoch::BIGINT AS epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5(epoch::VARCHAR || ':' || doc_id::VARCHAR)) - 1 AS pos FROM e")
def l15b(d):
    """As many epochs as 2500 samples need, each in an order of its own."""
    ids = d.select("doc_id").distinct()
    epochs = ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.lit(2500) / F.col("n")) - 1)).alias("epoch"))
    return op.numbered(epochs, F.md5(F.concat_ws(":", "epoch", "doc_id")), by_key=["epoch"]).select("epoch", "doc_id", "pos")


@query("l15_epochs", "documents", POS7 + ", e AS (SELECT doc_id, n, unnest(range((2500 + n - 1) // n)) AS epoch FROM o) SELECT epoch, count(*)::BIGINT AS n FROM e GROUP BY epoch")
def l15(d):
    return ordered(d).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.lit(2500) / F.col("n")) - 1)).alias("epoch")).groupBy("epoch").agg(F.count("*").alias("n"))


@query("l17_smoothed_weights", "toxic_reddit", "WITH c AS (SELECT source, count(*) AS n FROM toxic_reddit WHERE source IS NOT NULL GROUP BY source), w AS (SELECT source, pow(n, 0.3) * (1 - n / sum(n) OVER ()) AS x FROM c) SELECT source, round(x / sum(x) OVER (), 6) AS weight FROM w")
def l17(t):
    every = Window.partitionBy()
    c = t.where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    w = c.select("source", (F.pow("n", F.lit(0.3)) * (1 - F.col("n") / F.sum("n").over(every))).alias("x"))
    return w.select("source", F.round(F.col("x") / F.sum("x").over(every), 6).alias("weight"))


@query("l18_top_k", "embeddings", "SELECT vec_id, pos::BIGINT AS pos FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS r FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) WHERE r <= 3")
def l18(e):
    x = e.select("vec_id", F.posexplode("embedding").alias("p", "x"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("x"), "p")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 3").select("vec_id", (F.col("p") + 1).cast("bigint").alias("pos"))


@query("l18_nucleus", "embeddings", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM x), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, pos ROWS UNBOUNDED PRECEDING) - p AS before FROM p) SELECT vec_id, count(*)::BIGINT AS kept, min(pos)::BIGINT AS first FROM c WHERE before <= 0.3 + 1e-9 GROUP BY vec_id")
def l18b(e):
    """The most likely positions until their probabilities pass 0.3, the one that passes it included."""
    kept = op.nucleus(F.col("embedding").cast("array<double>"), 0.3)
    return e.select("vec_id", kept.alias("k")).select("vec_id", F.size("k").cast("bigint").alias("kept"), (F.array_min("k") + 1).cast("bigint").alias("first"))


@query("l19_limit_per_source", "unseen_data", "WITH u AS (SELECT DISTINCT id, source FROM unseen_data) SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || id)) AS r FROM u) WHERE r <= 10")
def l19(u):
    return op.balanced(u.select("id", "source").distinct(), "source", "id", 10, 5).select("id", "source")


@query("l20_sample_n", "documents", POS.format(s=11) + "SELECT doc_id FROM o WHERE pos < 64")
def l20(d):
    return ordered(d, 11).where("pos < 64").select("doc_id")


@query("l21_subsamples", "civil_comments", "WITH c AS (SELECT DISTINCT comment_id FROM civil_comments), x AS (SELECT k, comment_id, row_number() OVER (PARTITION BY k ORDER BY md5(k::VARCHAR || ':' || comment_id::VARCHAR)) AS r FROM c CROSS JOIN (SELECT unnest(range(5)) AS k)) SELECT k, comment_id FROM x WHERE r <= 30")
def l21(c):
    each = c.select("comment_id").distinct().select("comment_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("k"))
    w = Window.partitionBy("k").orderBy(F.md5(F.concat_ws(":", "k", "comment_id")))
    return each.withColumn("r", F.row_number().over(w)).where("r <= 30").select("k", "comment_id")


LEN = ITEMS + ", l AS (SELECT item_id, len(a) + 1 AS n, sum(len(a) + 1) OVER (ORDER BY item_id) - (len(a) + 1) AS g FROM d) "


def offsets(i):
    """Items with their number of tokens, an end token included, and the tokens before them; the tokens themselves stay behind."""
    return op.running(each_item(i, n=F.size("a") + 1), F.col("n"), ["item_id"], F.floor(F.col("item_id") / 256), "g")


@query("s1_pack", "input_ids", ITEMS + f""", t AS (SELECT item_id, unnest(a || [{EOS}]) AS x, unnest(range(len(a) + 1)) AS p FROM d), g AS (SELECT x, row_number() OVER (ORDER BY item_id, p) - 1 AS g, count(*) OVER () AS n FROM t)
 SELECT (g // 2048)::BIGINT AS seq, count(*)::BIGINT AS n, sum(x)::BIGINT AS total, md5(string_agg(x::VARCHAR, ',' ORDER BY g)) AS ids FROM g WHERE g // 2048 < n // 2048 GROUP BY g // 2048""")
def s1(i):
    """Concatenate, an end token after each item, and cut into sequences of 2048; the last partial one is dropped."""
    rows = tk.pack(items(i), "item_id", {"a": EOS}, 2048)
    return rows.select("seq", F.size("a").cast("bigint").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"), F.md5(F.array_join(F.col("a").cast("array<string>"), ",")).alias("ids"))


@query("s2_pack_shards", "input_ids", ITEMS + "SELECT item_id % 4 AS shard, sum(len(a) + 1)::BIGINT // 2048 AS sequences, sum(len(a) + 1)::BIGINT % 2048 AS dropped FROM d GROUP BY item_id % 4")
def s2(i):
    n = F.sum("n")
    return each_item(i, n=F.size("a") + 1).groupBy((F.col("item_id") % 4).alias("shard")).agg(F.floor(n / 2048).alias("sequences"), (n % 2048).alias("dropped"))


@query("s3_sample_index", "input_ids", LEN + ", k AS (SELECT unnest(range(0, (SELECT sum(n) - 1 FROM l)::BIGINT // 2048)) AS k) SELECT k.k AS sample, l.item_id, (k.k * 2048 - l.g)::BIGINT AS pos FROM k JOIN l ON k.k * 2048 >= l.g AND k.k * 2048 < l.g + l.n")
def s3(i):
    """Sample k starts at token 2048 k, and its last token is the first of the next."""
    o = offsets(i)
    total = o.agg(F.floor((F.sum("n") - 1) / 2048).alias("k"))
    first, last = F.ceil(F.col("g") / 2048), F.floor((F.col("g") + F.col("n") - 1) / 2048)
    e = o.where(first <= last).select("item_id", "g", F.explode(F.sequence(first, last)).alias("sample")).crossJoin(F.broadcast(total)).where("sample < k")
    return e.select("sample", "item_id", (F.col("sample") * 2048 - F.col("g")).alias("pos"))


@query("w6_pointers", "input_ids", LEN + "SELECT item_id, (g * 2)::BIGINT AS pointer FROM l")
def w6(i):
    return offsets(i).select("item_id", (F.col("g") * 2).alias("pointer"))


@query("w7_chunk_offsets", "input_ids", ITEMS + "SELECT item_id, (sum(len(a) // 16) OVER (ORDER BY item_id) - len(a) // 16)::BIGINT AS chunk FROM d")
def w7(i):
    return op.running(each_item(i, c=F.floor(F.size("a") / 16)), F.col("c"), ["item_id"], F.floor(F.col("item_id") / 256), "chunk").select("item_id", "chunk")


@query("w4_token_budget", "input_ids", LEN + "SELECT item_id FROM l WHERE g + n <= 50000")
def w4(i):
    return offsets(i).where("g + n <= 50000").select("item_id")


@query("f23_sequence_budget", "label_mask", "WITH d AS (SELECT item_id, max(label_mask) AS m FROM label_mask WHERE label_mask IS NOT NULL GROUP BY item_id), e AS (SELECT item_id, len([x for x in m if x = 3]) AS n FROM d) SELECT item_id FROM (SELECT item_id, sum(n) OVER (ORDER BY item_id) AS s FROM e) WHERE s <= 3000")
def f23(m):
    one = m.where("label_mask is not null").groupBy("item_id").agg(F.max(ar.count_of(F.col("label_mask"), 3)).alias("n"))
    return op.running(one, F.col("n"), ["item_id"], F.floor(F.col("item_id") / 256), "before").where("before + n <= 3000").select("item_id")


@query("w1_adjacent", "events", "SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events")
def w1(e):
    return e.select("event_id", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("following"))


@query("w5_choice_rank", "lineitem", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC)::BIGINT AS r FROM lineitem")
def w5(x):
    return x.select("l_orderkey", "l_linenumber", F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"))).cast("bigint").alias("r"))


@query("w8_islands", "input_ids", "WITH i AS (SELECT DISTINCT item_id FROM input_ids WHERE len(input_ids) > 100), k AS (SELECT item_id, item_id - row_number() OVER (ORDER BY item_id) AS island FROM i) SELECT min(item_id) AS first, max(item_id) AS last, count(*)::BIGINT AS n FROM k GROUP BY island")
def w8(i):
    one = i.where(F.size("input_ids") > 100).select("item_id").distinct()
    k = op.running(one, F.lit(1), ["item_id"], F.floor(F.col("item_id") / 256), "r").withColumn("island", F.col("item_id") - F.col("r"))
    return k.groupBy("island").agg(F.min("item_id").alias("first"), F.max("item_id").alias("last"), F.count("*").alias("n")).drop("island")


@query("w9_first_run", "label_mask", "WITH d AS (SELECT item_id, max(label_mask) AS m FROM label_mask WHERE len(label_mask) > 0 GROUP BY item_id) SELECT item_id, (coalesce(list_min([k for k in range(1, len(m) + 1) if m[k] <> 1]), len(m) + 1) - 1)::BIGINT AS run FROM d")
def w9(m):
    stop = F.array_min(F.filter(F.transform("label_mask", lambda x, k: F.when(x != 1, k)), lambda k: k.isNotNull()))
    return m.where(F.size("label_mask") > 0).groupBy("item_id").agg(F.max(F.coalesce(stop, F.size("label_mask"))).cast("bigint").alias("run"))


@query("u1_concat", "toxic_reddit non_toxic_reddit", "SELECT source, count(*)::BIGINT AS n FROM (SELECT source FROM toxic_reddit UNION ALL SELECT source FROM non_toxic_reddit) GROUP BY source")
def u1(a, b):
    return a.select("source").unionByName(b.select("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("u2_distinct", "toxic_reddit", "SELECT DISTINCT subreddit, source FROM toxic_reddit")
def u2(t):
    return t.select("subreddit", "source").distinct()


@query("u3_distinct_in_order", "input_ids", ITEMS + "SELECT item_id, len(list_distinct(a))::BIGINT AS n FROM d")
def u3(i):
    return each_item(i, n=F.size(F.array_distinct("a")).cast("bigint"))


@query("u4_collapse_restore", "toxic_reddit", "SELECT t.id, r.first_id FROM (SELECT DISTINCT id, md5(text) AS m FROM toxic_reddit WHERE text IS NOT NULL) t JOIN (SELECT md5(text) AS m, min(id) AS first_id FROM toxic_reddit WHERE text IS NOT NULL GROUP BY md5(text)) r USING (m)")
def u4(t):
    keyed = t.where("text is not null").select("id", F.md5("text").alias("m"))
    return keyed.distinct().join(keyed.groupBy("m").agg(F.min("id").alias("first_id")), "m").select("id", "first_id")


@query("u5_bag_intersect", "paradetox", "SELECT DISTINCT pair_id, len(list_intersect(string_split(en_toxic_comment, ' '), string_split(en_neutral_comment, ' ')))::BIGINT AS both_words FROM paradetox WHERE en_toxic_comment IS NOT NULL AND en_neutral_comment IS NOT NULL")
def u5(p):
    return p.where("en_toxic_comment is not null and en_neutral_comment is not null").select("pair_id", F.size(F.array_intersect(F.split("en_toxic_comment", " "), F.split("en_neutral_comment", " "))).cast("bigint").alias("both_words")).distinct()


@query("snk8_merge_index", "input_ids", LEN + "SELECT item_id, n::BIGINT AS size, g::BIGINT AS pointer FROM l")
def snk8(i):
    return offsets(i).select("item_id", F.col("n").cast("bigint").alias("size"), F.col("g").alias("pointer"))


@query("snk10_split_bytes", "documents", "WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b FROM documents) SELECT doc_id, ((sum(b) OVER (ORDER BY doc_id) - b) // 100000)::BIGINT AS shard FROM d")
def snk10(d):
    b = d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"))
    return op.running(b, F.col("b"), ["doc_id"], F.floor(F.col("doc_id") / 512), "before").select("doc_id", F.floor(F.col("before") / 100000).alias("shard"))


@query("snk11_split_lines", "documents", POS7 + "SELECT doc_id, pos // 120 AS shard FROM o")
def snk11(d):
    return ordered(d).select("doc_id", F.floor(F.col("pos") / 120).alias("shard"))


@query("snk12_dead_letters", "events", "SELECT event_id AS index, 'CAST_INVALID_INPUT' AS error, coalesce(props::JSON->>'$.page', 'null') AS message FROM events WHERE try_cast(props::JSON->>'$.page' AS INT) IS NULL")
def snk12(e):
    """The rows whose page is no number, as index, error and message."""
    page = F.get_json_object("props", "$.page")
    return sinks.dead_letters(e, page.try_cast("int").isNotNull(), F.col("event_id"), "CAST_INVALID_INPUT", F.coalesce(page, F.lit("null")))


@query("snk13_metric_table", "civil_comments", "SELECT '| toxicity | ' || printf('%.4f', avg(toxicity)) || ' |' AS line FROM civil_comments")
def snk13(c):
    return c.agg(F.format_string("| toxicity | %.4f |", F.avg("toxicity")).alias("line"))


@query("src16_rank_index", "documents", POS7 + ", r AS (SELECT pos // 64 AS step, string_agg(doc_id::VARCHAR, chr(9) ORDER BY pos) AS ids FROM o GROUP BY 1), l AS (SELECT step::VARCHAR || chr(9) || ids AS line FROM r), s AS (SELECT split_part(line, chr(9), 1)::BIGINT AS step, string_split(line, chr(9)) AS f FROM l), e AS (SELECT step, unnest(range(1, len(f))) AS k, f FROM s) SELECT step, k::BIGINT AS place, doc_id, length(text)::BIGINT AS n FROM e JOIN documents ON doc_id = f[k + 1]::BIGINT")
def src16(d):
    """Index lines of a step and the ids of its batch, read back and joined with the documents they name."""
    o = ordered(d).groupBy(F.floor(F.col("pos") / 64).alias("step")).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id"))).alias("b"))  # 64 rows each
    lines = o.select(F.concat_ws("\t", "step", F.transform("b", lambda x: x["doc_id"].cast("string"))).alias("line"))
    return op.indexed(lines, "line", d.select("doc_id", F.length("text").cast("bigint").alias("n")), "doc_id")


@query("src10_order_batch", "documents", POS7 + "SELECT pos, o.doc_id, length(t.text)::BIGINT AS n FROM o JOIN documents t ON o.doc_id = t.doc_id WHERE pos >= 64 AND pos < 128")
def src10(d):
    return ordered(d).where("pos >= 64 and pos < 128").select("pos", "doc_id").join(d.select("doc_id", "text"), "doc_id").select("pos", "doc_id", F.length("text").cast("bigint").alias("n"))
