"""Queries of filters and projections on tagged records (F and P operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import spans as sp
from quarrymill.functions.text import let
from quarrymill.operators import filters as op
from quarrymill.plans.registry import query

SPANS = "[{'start': s[1]::INT, 'end': s[2]::INT, 'score': s[3]} for s in toxic_spans if s is not null and len(s) = 3 and s[1] is not null and s[2] is not null and s[3] is not null]"
TAGGED = f"WITH t AS (SELECT *, {SPANS} AS spans FROM toxic_reddit), u AS (SELECT *, [s.score for s in spans] AS v FROM t) "


def tagged(df):
    """Records with typed spans."""
    return df.withColumn("spans", sp.typed(F.col("toxic_spans")))


@query("f1_ingest", "toxic_reddit", "SELECT id, length(text)::BIGINT AS n FROM toxic_reddit WHERE length(text) >= 200 AND score >= 2")
def f1(t):
    return op.ingest(t, "text", "score", 200, 2).select("id", F.length("text").cast("bigint").alias("n"))


@query("f2_toxic_mix", "toxic_reddit", TAGGED + "SELECT id, round(toxic_score, 6) AS toxic_score FROM u WHERE english_score >= 0.5 AND toxic_score >= 0.7 AND len(v) > 1 AND list_max(v) >= 0.7 AND list_min(v) <= 0.1")
def f2(t):
    return op.toxic_mix(tagged(t), 0.5, 0.7, 0.1).select("id", F.round("toxic_score", 6).alias("toxic_score"))


@query("f3_non_toxic", "toxic_reddit", TAGGED + "SELECT id FROM u WHERE english_score >= 0.5 AND toxic_score <= 0.1 AND len(v) > 1 AND list_max(v) <= 0.1")
def f3(t):
    return op.non_toxic(tagged(t), 0.5, 0.1).select("id")


@query("f4_ratio", "toxic_reddit", TAGGED + "SELECT id FROM u WHERE len(v) > 1 AND list_max(v) >= 0.9 AND list_min(v) <= 0.1 AND len([x for x in v if x >= 0.9])::DOUBLE / len(v) >= 0.3")
def f4(t):
    return op.toxic_ratio(tagged(t), 0.9, 0.1, 0.3).select("id")


@query("f5_clean_only", "toxic_reddit", TAGGED + "SELECT id FROM u WHERE list_max(v) <= 0.1")
def f5(t):
    return op.clean_only(tagged(t), 0.1).select("id")


@query("f6_share_between", "toxic_reddit", TAGGED + "SELECT id FROM u WHERE len(v) > 0 AND len([x for x in v if x > 0.5])::DOUBLE / len(v) >= 0.1 AND len([x for x in v if x > 0.5])::DOUBLE / len(v) < 0.25")
def f6(t):
    return op.share_between(tagged(t), 0.1, 0.25, 0.5).select("id")


@query("f8_exclude_any", "toxic_reddit", "SELECT id FROM toxic_reddit WHERE NOT (coalesce(toxic_score <= 0.1, false) OR coalesce(english_score <= 0.9, false) OR coalesce(score < 0, false))")
def f8(t):
    return op.exclude_any(t, F.col("toxic_score") <= 0.1, F.col("english_score") <= 0.9, F.col("score") < 0).select("id")


BLOCKED = "SELECT subreddit FROM toxic_reddit WHERE subreddit IS NOT NULL GROUP BY subreddit HAVING count(*) >= 15"


@query("f9_block_list", "toxic_reddit", f"SELECT id, subreddit FROM toxic_reddit t WHERE NOT EXISTS (SELECT 1 FROM ({BLOCKED}) b WHERE b.subreddit = t.subreddit)")
def f9(t):
    blocked = t.where("subreddit is not null").groupBy("subreddit").count().where("count >= 15").select("subreddit")
    return op.not_listed(t, "subreddit", blocked).select("id", "subreddit")


@query("f10_max_length", "documents", "SELECT doc_id FROM documents WHERE length(text) <= 500")
def f10(d):
    return d.where(F.length("text") <= 500).select("doc_id")


@query("f11_language_cut", "non_toxic_reddit", "SELECT id FROM non_toxic_reddit WHERE NOT (english_score < 0.5)")
def f11(t):
    return t.where(~(F.col("english_score") < 0.5)).select("id")


@query("f12_split", "paradetox", "SELECT pair_id, source FROM paradetox WHERE split = 'test' AND (source LIKE '%e%' OR source LIKE '%w%')")
def f12(p):
    return p.where((F.col("split") == "test") & (F.contains("source", F.lit("e")) | F.contains("source", F.lit("w")))).select("pair_id", "source")


@query("f13_adversarial", "wildguard", "SELECT item_id FROM wildguard WHERE adversarial = false AND length(prompt) <= 400")
def f13(w):
    return w.where((F.col("adversarial") == F.lit(False)) & (F.length("prompt") <= 400)).select("item_id")


@query("f14_keyword_split", "civil_comments", "SELECT comment_id, CASE WHEN contains(text, 'harbour') OR contains(text, 'library') OR contains(text, 'you') THEN 'test' ELSE 'train' END AS part FROM civil_comments WHERE text IS NOT NULL")
def f14(c):
    return c.where("text is not null").select("comment_id", F.when(op.has_word(F.col("text"), ["harbour", "library", "you"]), "test").otherwise("train").alias("part"))


@query("f16_exclude_middle", "civil_comments", "SELECT comment_id, round(toxicity, 6) AS toxicity FROM civil_comments WHERE toxicity <= 0.2 OR toxicity >= 0.8")
def f16(c):
    return op.outside(c, "toxicity", 0.2, 0.8).select("comment_id", F.round("toxicity", 6).alias("toxicity"))


@query("f17_not_null", "wildguard", "SELECT item_id, prompt_harm_label FROM wildguard WHERE prompt_harm_label IS NOT NULL")
def f17(w):
    return w.where("prompt_harm_label is not null").select("item_id", "prompt_harm_label")


@query("f18_trained_tokens", "label_mask", "SELECT item_id, len([m for m in label_mask if m = 3])::BIGINT AS n FROM label_mask WHERE len([m for m in label_mask if m = 3]) > 0")
def f18(m):
    n = F.size(F.filter("label_mask", lambda x: x == 3)).cast("bigint")
    return m.where(n > 0).select("item_id", n.alias("n"))


@query("f22_blank", "documents", "SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0")
def f22(d):
    return d.where(F.length(F.btrim("text", F.lit(" \t\n\r"))) > 0).select("doc_id")


@query("f24_pair_consistency", "paradetox", "SELECT pair_id FROM paradetox GROUP BY pair_id HAVING count(DISTINCT source) = 1 AND count(DISTINCT split) = 1 AND count(*) > 1")
def f24(p):
    per = p.groupBy("pair_id").agg(F.count_distinct("source").alias("s"), F.count_distinct("split").alias("t"), F.count("*").alias("n"))
    return per.where("s = 1 and t = 1 and n > 1").select("pair_id")


@query("src12_non_empty", "documents", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) > 0")
def src12(d):
    return d.where(F.length("text") > 0).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("pr1_raw_project", "toxic_reddit", "SELECT text, 'reddit' AS source, id FROM toxic_reddit WHERE text IS NOT NULL")
def p1(t):
    return t.where("text is not null").select("text", F.lit("reddit").alias("source"), "id")


@query("pr2_lift_scores", "toxic_reddit", TAGGED + "SELECT id, v[1] AS first_score, len(v)::BIGINT AS n FROM u")
def p2(t):
    return tagged(t).select("id", F.get("spans", F.lit(0))["score"].alias("first_score"), F.when(F.col("spans").isNotNull(), F.size("spans")).cast("bigint").alias("n"))


@query("pr3_rename", "input_ids", "SELECT item_id AS seq_id, len(input_ids)::BIGINT AS n FROM input_ids")
def p3(i):
    return i.withColumnRenamed("item_id", "seq_id").select("seq_id", F.when(F.col("input_ids").isNotNull(), F.size("input_ids")).cast("bigint").alias("n"))


@query("pr4_cast_list", "input_ids", "SELECT item_id, list_sum([x::BIGINT for x in input_ids])::BIGINT AS s FROM input_ids WHERE len(input_ids) > 0")
def p4(i):
    return i.where(F.size("input_ids") > 0).select("item_id", F.aggregate(F.col("input_ids").cast("array<bigint>"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("s"))


@query("pr5_constant_mask", "input_ids", "SELECT item_id, len(input_ids)::BIGINT AS n, len([1 for x in input_ids])::BIGINT AS ones FROM input_ids WHERE input_ids IS NOT NULL")
def p5(i):
    mask = F.array_repeat(F.lit(1), F.size("input_ids"))
    return i.where("input_ids is not null").select("item_id", F.size("input_ids").cast("bigint").alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("bigint").alias("ones"))


@query("pr6_span_label", "toxic_reddit", TAGGED + "SELECT id, array_to_string([CASE WHEN x > 0.9 THEN 1 WHEN x < 0.1 THEN 0 ELSE -1 END for x in v], ',') AS labels FROM u WHERE len(v) > 0")
def p6(t):
    return tagged(t).where(F.size("spans") > 0).select("id", F.array_join(F.transform("spans", lambda s: sp.label(s["score"], 0.1, 0.9).cast("string")), ",").alias("labels"))


@query("pr7_mask_code", "toxic_reddit", TAGGED + "SELECT id, array_to_string([CASE WHEN x > 0.9 THEN 3 WHEN x > 0.1 THEN 2 ELSE 1 END for x in v], ',') AS codes FROM u WHERE len(v) > 0")
def p7(t):
    return tagged(t).where(F.size("spans") > 0).select("id", F.array_join(F.transform("spans", lambda s: sp.mask_code(s["score"], 0.1, 0.9).cast("string")), ",").alias("codes"))


EXCISED = """, g AS (SELECT id, text, spans, list_reduce([text] || [s.start::VARCHAR || ':' || s.end::VARCHAR for s in list_reverse([s for s in spans if s.score > 0.5])],
 lambda acc, s: substr(acc, 1, split_part(s, ':', 1)::INT) || substr(acc, split_part(s, ':', 2)::INT + {k})) AS kept FROM t WHERE text IS NOT NULL AND spans IS NOT NULL) SELECT id, md5(kept) AS kept, length(kept)::BIGINT AS n FROM g"""


@query("pr8_span_excision", "toxic_reddit", TAGGED + EXCISED.format(k=2))
def p8(t):
    kept = sp.excise(F.col("text"), F.col("spans"), 0.5)
    return tagged(t).where("text is not null and spans is not null").select("id", kept.alias("k")).select("id", F.md5("k").alias("kept"), F.length("k").cast("bigint").alias("n"))


@query("pr9_excision_exclusive", "toxic_reddit", TAGGED + EXCISED.format(k=1))
def p9(t):
    kept = sp.excise(F.col("text"), F.col("spans"), 0.5, inclusive_end=False)
    return tagged(t).where("text is not null and spans is not null").select("id", kept.alias("k")).select("id", F.md5("k").alias("kept"), F.length("k").cast("bigint").alias("n"))


@query("pr10_segments", "toxic_reddit", TAGGED + """, d AS (SELECT DISTINCT id, text, spans FROM t WHERE text IS NOT NULL AND len(spans) > 0),
 e AS (SELECT id, text, unnest(spans) AS s, generate_subscripts(spans, 1) AS pos FROM d)
 SELECT id, pos::BIGINT AS pos, md5(substr(text, coalesce(lag(s.end) OVER (PARTITION BY id ORDER BY pos), 0) + 1, greatest(s.end - coalesce(lag(s.end) OVER (PARTITION BY id ORDER BY pos), 0), 0))) AS segment FROM e""")
def p10(t):
    """Every span with the gap before it, as one segment."""
    one = tagged(t).where((F.size("spans") > 0) & F.col("text").isNotNull()).select("id", "text", "spans")
    begin = let(F.col("spans"), lambda all_: F.transform(all_, lambda s, i: F.when(i == 0, 0).otherwise(F.get(all_, i - 1)["end"])))
    seg = F.transform(F.arrays_zip(F.col("spans").alias("s"), begin.alias("b")), lambda z: F.md5(F.substring("text", z["b"] + 1, F.greatest(z["s"]["end"] - z["b"], F.lit(0)))))
    return one.select("id", seg.alias("s")).distinct().select("id", F.posexplode("s").alias("p", "segment")).select("id", (F.col("p") + 1).cast("bigint").alias("pos"), "segment")


@query("pr13_split_marker", "documents", "SELECT md5(part) AS id, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS part FROM documents WHERE text IS NOT NULL) WHERE part <> '' GROUP BY part")
def p13(d):
    return d.where("text is not null").select(F.explode(F.split("text", "\n")).alias("part")).where("part <> ''").groupBy(F.md5("part").alias("id")).agg(F.count("*").alias("n"))


@query("pr14_adjacent_pairs", "toxic_reddit", TAGGED + """, d AS (SELECT DISTINCT id, text, spans FROM t WHERE text IS NOT NULL AND len(spans) > 1), e AS (SELECT id, text, unnest(spans) AS s, generate_subscripts(spans, 1) AS pos FROM d),
 f AS (SELECT *, lead(s) OVER (PARTITION BY id ORDER BY pos) AS z FROM e) SELECT id, pos::BIGINT AS pos, md5(substr(text, s.start + 1, greatest(s.end - s.start, 0)) || ' ' || substr(text, z.start + 1, greatest(z.end - z.start, 0))) AS pair FROM f WHERE s.score < 0.1 AND z.score > 0.9""")
def p14(t):
    """A clean sentence followed by a toxic one."""
    one = tagged(t).where((F.size("spans") > 1) & F.col("text").isNotNull()).select("id", "text", "spans")
    both = F.arrays_zip(F.col("spans").alias("a"), F.slice("spans", F.lit(2), F.size("spans")).alias("b"))
    cut = lambda s: F.substring("text", s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0)))
    e = one.select("id", "text", F.posexplode(both).alias("p", "z")).where((F.col("z.a.score") < 0.1) & (F.col("z.b.score") > 0.9))
    return e.select("id", (F.col("p") + 1).cast("bigint").alias("pos"), F.md5(F.concat_ws(" ", cut(F.col("z.a")), cut(F.col("z.b")))).alias("pair")).distinct()


@query("pr17_template", "wildguard", "SELECT item_id, 'Prompt: ' || prompt || chr(10) || 'Label: ' || coalesce(prompt_harm_label, 'unknown') AS shot FROM wildguard WHERE prompt IS NOT NULL")
def p17(w):
    return w.where("prompt is not null").select("item_id", F.concat(F.lit("Prompt: "), "prompt", F.lit("\nLabel: "), F.coalesce("prompt_harm_label", F.lit("unknown"))).alias("shot"))


@query("pr21_one_hot", "toxic_reddit", "SELECT id, (contains(text, 'the'))::INT AS a, (contains(text, 'you'))::INT AS b, (contains(text, 'fan'))::INT AS c FROM toxic_reddit WHERE text IS NOT NULL")
def p21(t):
    return t.where("text is not null").select("id", *[F.contains("text", F.lit(w)).cast("int").alias(a) for a, w in (("a", "the"), ("b", "you"), ("c", "fan"))])


@query("pr30_nested", "wildguard", "SELECT item_id, upper(prompt) AS shouted FROM wildguard")
def p30(w):
    return w.select("item_id", F.struct(F.struct(F.upper("prompt").alias("text")).alias("prompt")).alias("row")).select("item_id", F.col("row.prompt.text").alias("shouted"))


@query("pr31_softmax", "civil_comments", "SELECT comment_id, round(1 / (1 + exp(insult - toxicity)), 6) AS p FROM civil_comments WHERE insult IS NOT NULL AND toxicity IS NOT NULL")
def p31(c):
    return c.where("insult is not null and toxicity is not null").select("comment_id", F.round(1 / (1 + F.exp(F.col("insult") - F.col("toxicity"))), 6).alias("p"))


@query("pr32_completion_cut", "documents", "SELECT doc_id, md5(trim(split_part(text, 'User:', 1), ' ' || chr(10))) AS answer FROM documents WHERE text IS NOT NULL")
def p32(d):
    return d.where("text is not null").select("doc_id", F.md5(F.btrim(F.split_part("text", F.lit("User:"), F.lit(1)), F.lit(" \n"))).alias("answer"))


@query("pr35_steps", "lineitem", "SELECT l_returnflag, ceil(count(*) / (8.0 * 4))::BIGINT * 3 AS steps FROM lineitem GROUP BY l_returnflag")
def p35(x):
    return x.groupBy("l_returnflag").agg((F.ceil(F.count("*") / 32) * 3).alias("steps"))


@query("w2_removed_before", "toxic_reddit", TAGGED + """, d AS (SELECT DISTINCT id, spans FROM t WHERE len(spans) > 0), e AS (SELECT id, unnest(spans) AS s, generate_subscripts(spans, 1) AS pos FROM d)
 SELECT id, pos::BIGINT AS pos, coalesce(sum(CASE WHEN s.score > 0.5 THEN s.end - s.start + 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS removed FROM e""")
def w2(t):
    """Characters that excision removes before each span."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("before"))
    walk = F.aggregate("spans", start, lambda a, y: F.struct((a["n"] + F.when(y["score"] > 0.5, y["end"] - y["start"] + 1).otherwise(0)).alias("n"), F.concat(a["before"], F.array(a["n"])).alias("before")))
    one = tagged(t).where(F.size("spans") > 0).select("id", walk["before"].alias("gone")).distinct()
    return one.select("id", F.posexplode("gone").alias("p", "r")).select("id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("r").cast("bigint").alias("removed"))


@query("b5_build_records", "paradetox", "SELECT DISTINCT pair_id::VARCHAR AS id, en_toxic_comment || chr(10) || en_neutral_comment AS text, 'paradetox/' || coalesce(split, '') AS source FROM paradetox WHERE en_toxic_comment IS NOT NULL AND en_neutral_comment IS NOT NULL")
def b5(p):
    return p.where("en_toxic_comment is not null and en_neutral_comment is not null").select(F.col("pair_id").cast("string").alias("id"), F.concat_ws("\n", "en_toxic_comment", "en_neutral_comment").alias("text"), F.concat(F.lit("paradetox/"), F.coalesce("split", F.lit(""))).alias("source")).distinct()
