"""Queries on token arrays and strings (P11-P34, A operators, F18-F21)."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from quarrymill.functions import arrays as ar
from quarrymill.functions.text import let
from quarrymill.operators import tokens as tk
from quarrymill.plans.registry import query

ITEMS = "WITH d AS (SELECT item_id, max(input_ids) AS a FROM input_ids WHERE len(input_ids) > 0 GROUP BY item_id) "
EOS = 50279


def items(i):
    """One row for each item with tokens, for results that need the tokens of all rows."""
    return i.where(F.size("input_ids") > 0).groupBy("item_id").agg(F.max("input_ids").alias("a"))


def each_item(i, **columns):
    """One row for each item with tokens: the columns (of a, its tokens) are computed first, and only they are shuffled
    when repeated rows become one. A null condition column named keep drops rows."""
    rows = i.where(F.size("input_ids") > 0).select("item_id", F.col("input_ids").alias("a"))
    if "keep" in columns:
        rows = rows.where(columns.pop("keep"))
    if not columns:
        return rows.select("item_id").distinct()
    return rows.select("item_id", F.struct(*[v.alias(k) for k, v in columns.items()]).alias("r")).groupBy("item_id").agg(F.max("r").alias("r")).select("item_id", "r.*")


def digest(c):
    """An array as text, digested, for comparison across engines."""
    return F.md5(F.array_join(c.cast("array<string>"), ","))


@query("pr11_word_tokens", "paradetox", "SELECT pair_id, array_to_string(regexp_extract_all(en_toxic_comment, '[^ ]+'), '|') AS tokens FROM paradetox WHERE en_toxic_comment IS NOT NULL")
def p11(p):
    return p.where("en_toxic_comment is not null").select("pair_id", F.array_join(F.regexp_extract_all("en_toxic_comment", F.lit("[^ ]+"), F.lit(0)), "|").alias("tokens"))


@query("pr15_pad", "input_ids", ITEMS + "SELECT item_id, md5(array_to_string(a[1:256] || [0 for x in range(greatest(256 - len(a), 0))], ',')) AS ids, md5(array_to_string([1 for x in a[1:256]] || [0 for x in range(greatest(256 - len(a), 0))], ',')) AS mask FROM d")
def p15(i):
    return each_item(i, ids=digest(ar.pad(F.col("a"), 256, 0)), mask=digest(ar.pad(F.transform("a", lambda x: F.lit(1)), 256, 0)))


@query("pr18_classifier_row", "input_ids", ITEMS + """SELECT item_id, len(a) > 511 AS skip, md5(array_to_string(a[1:511] || [1 for x in range(greatest(511 - len(a), 0))], ',')) AS ids, least(len(a), 511)::BIGINT AS label_position FROM d""")
def p18(i):
    return each_item(i, skip=(F.size("a") > 511), ids=digest(ar.pad(F.col("a"), 511, 1)), label_position=F.least(F.size("a"), F.lit(511)).cast("bigint"))


@query("pr19_left_pad", "input_ids", ITEMS + "SELECT item_id, md5(array_to_string([1 for x in range(greatest(128 - len(a), 0))] || a[1:128], ',')) AS ids FROM d")
def p19(i):
    return each_item(i, ids=digest(ar.pad(F.col("a"), 128, 1, left=True)))


@query("pr20_mask_pattern", "input_ids", ITEMS + "SELECT item_id, len([x for x in a if x <> 15838 and x <> 7919])::BIGINT AS kept, md5(array_to_string([CASE WHEN x = 15838 OR x = 7919 THEN 0 ELSE 1 END for x in a], ',')) AS mask FROM d")
def p20(i):
    """Mask 0 on listed tokens."""
    mask = F.transform("a", lambda x: F.when(x.isin(15838, 7919), 0).otherwise(1))
    return each_item(i, kept=F.aggregate(mask, F.lit(0), lambda n, x: n + x).cast("bigint"), mask=digest(mask))


@query("pr22_chat_flatten", "paradetox", """SELECT pair_id, md5(string_agg('<|' || role || '|>' || chr(10) || content, chr(10) ORDER BY turn)) AS chat, sum(CASE WHEN role = 'assistant' THEN length(content) ELSE 0 END)::BIGINT AS trained FROM (
 SELECT pair_id, 1 AS turn, 'user' AS role, max(en_toxic_comment) AS content FROM paradetox GROUP BY pair_id UNION ALL SELECT pair_id, 2, 'assistant', max(en_neutral_comment) FROM paradetox GROUP BY pair_id) WHERE content IS NOT NULL GROUP BY pair_id""")
def p22(p):
    one = p.groupBy("pair_id").agg(F.max("en_toxic_comment").alias("user"), F.max("en_neutral_comment").alias("assistant"))
    turns = one.select("pair_id", F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("content")) for r in ("user", "assistant")]), lambda t: t["content"].isNotNull()).alias("t")).where(F.size("t") > 0)
    said = F.transform("t", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["content"]))
    trained = F.aggregate("t", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["content"])).otherwise(0))
    return turns.select("pair_id", F.md5(F.array_join(said, "\n")).alias("chat"), trained.cast("bigint").alias("trained"))


@query("pr23_collate", "input_ids", ITEMS + ", e AS (SELECT *, item_id // 8 AS batch FROM d), f AS (SELECT *, max(len(a)) OVER (PARTITION BY batch) AS n FROM e) SELECT item_id, n::BIGINT AS width, md5(array_to_string(a || [0 for x in range(n - len(a))], ',')) AS ids FROM f")
def p23(i):
    rows = i.where(F.size("input_ids") > 0).select("item_id", F.col("input_ids").alias("a"))
    b = tk.collate(rows, F.floor(F.col("item_id") / 8), {"a": 0})
    return b.select("item_id", F.col("width").cast("bigint").alias("width"), digest(F.col("a")).alias("ids")).distinct()


@query("pr24_document_lengths", "input_ids", ITEMS + f", e AS (SELECT item_id, [k for k in range(1, len(a) + 1) if a[k] = {EOS}] AS p FROM d) SELECT item_id, array_to_string([p[k] - CASE WHEN k = 1 THEN 0 ELSE p[k - 1] END for k in range(1, len(p) + 1)], ',') AS lengths FROM e")
def p24(i):
    ends = F.filter(F.transform("a", lambda x, k: F.when(x == EOS, k + 1)), lambda k: k.isNotNull())
    lengths = F.zip_with("p", F.concat(F.array(F.lit(0)), F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0)))), lambda a, b: a - b)
    some = each_item(i, p=ends)
    return some.select("item_id", F.when(F.size("p") > 0, F.array_join(lengths.cast("array<string>"), ",")).otherwise("").alias("lengths"))


HITS = "[k - 1 for k in range(1, len(a)) if a[k] = 7919 and a[k + 1] = 15838]"


@query("a7_pattern_hits", "input_ids", ITEMS + f"SELECT item_id, array_to_string({HITS}, ',') AS hits FROM d WHERE len({HITS}) > 0")
def a7(i):
    h = ar.hits(F.col("a"), [7919, 15838])
    return each_item(i, hits=let(h, lambda x: F.array_join(x.cast("array<string>"), ","))).where("hits <> ''")


@query("f20_has_pattern", "input_ids", ITEMS + f"SELECT item_id FROM d WHERE len({HITS}) > 0")
def f20(i):
    return each_item(i, keep=F.size(ar.hits(F.col("a"), [7919, 15838])) > 0)


@query("f21_position_window", "input_ids", ITEMS + f", e AS (SELECT item_id, a, unnest({HITS}) AS i FROM d) SELECT item_id, count(*)::BIGINT AS n FROM e WHERE i >= 10 AND i + 2 <= len(a) GROUP BY item_id")
def f21(i):
    inside = let(ar.hits(F.col("a"), [7919, 15838]), lambda h: F.size(F.filter(h, lambda k: (k >= 10) & (k + 2 <= F.size("a")))))
    return each_item(i, n=inside.cast("bigint")).where("n > 0")


@query("pr26_prefix_mask", "input_ids", ITEMS + f", e AS (SELECT item_id, a, list_min({HITS}) AS i FROM d) SELECT item_id, md5(array_to_string([CASE WHEN i IS NOT NULL AND k < i + 2 THEN -100 ELSE a[k + 1] END for k in range(0, len(a))], ',')) AS labels FROM e")
def p26(i):
    masked = let(F.array_min(ar.hits(F.col("a"), [7919, 15838])), lambda first: F.transform("a", lambda x, k: F.when(k < first + 2, -100).otherwise(x)))
    return each_item(i, labels=digest(masked))


@query("pr27_pattern_mask", "input_ids", ITEMS + f", e AS (SELECT item_id, a, {HITS} AS h FROM d) SELECT item_id, md5(array_to_string([CASE WHEN list_contains(h, k) OR list_contains(h, k - 1) THEN -100 ELSE a[k + 1] END for k in range(0, len(a))], ',')) AS labels FROM e")
def p27(i):
    masked = let(ar.hits(F.col("a"), [7919, 15838]), lambda h: F.transform("a", lambda x, k: F.when(F.array_contains(h, k) | F.array_contains(h, k - 1), -100).otherwise(x)))
    return each_item(i, labels=digest(masked))


@query("pr28_context_window", "input_ids", ITEMS + f", e AS (SELECT item_id, a, list_min({HITS}) AS i FROM d) SELECT item_id, array_to_string(a[i - 3:i + 2], ',') AS around FROM e WHERE i >= 4")
def p28(i):
    around = let(F.array_min(ar.hits(F.col("a"), [7919, 15838])), lambda k: F.when(k >= 4, F.array_join(F.slice("a", k - 3, F.lit(6)).cast("array<string>"), ",")))
    return each_item(i, around=around).where("around is not null")


@query("pr33_windows", "input_ids", ITEMS + "SELECT item_id, unnest(range(0, len(a), 512))::BIGINT AS start, unnest([md5(array_to_string(a[k + 1:k + 512], ',')) for k in range(0, len(a), 512)]) AS window FROM d")
def p33(i):
    windows = F.transform(F.sequence(F.lit(0), F.size("a") - 1, F.lit(512)), lambda k: F.struct(k.cast("bigint").alias("start"), digest(F.slice("a", k + 1, F.lit(512))).alias("window")))
    return each_item(i, w=windows).select("item_id", F.inline("w"))


@query("pr34_truncate_eos", "input_ids", ITEMS + f"SELECT item_id, md5(array_to_string(CASE WHEN a[-1] = {EOS} AND len(a) <= 100 THEN a WHEN len(a) < 100 THEN a || [{EOS}] ELSE a[1:99] || [{EOS}] END, ',')) AS ids FROM d")
def p34(i):
    ended = (F.element_at("a", -1) == EOS) & (F.size("a") <= 100)
    return each_item(i, ids=digest(F.when(ended, F.col("a")).otherwise(F.concat(F.slice("a", 1, 99), F.array(F.lit(EOS))))))


@query("src11_slice", "input_ids", ITEMS + "SELECT item_id, array_to_string(a[6:15], ',') AS part FROM d")
def src11(i):
    return each_item(i, part=F.array_join(F.slice("a", 6, 10).cast("array<string>"), ","))


@query("f18_budget_items", "input_ids", ITEMS + "SELECT count(*)::BIGINT AS n, sum(len(a))::BIGINT AS tokens FROM d WHERE len(a) <= 2048")
def f18b(i):
    return each_item(i, n=F.size("a")).where("n <= 2048").agg(F.count("*").alias("n"), F.sum("n").alias("tokens"))


@query("a1_word_ngrams", "paradetox", "SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest([array_to_string(w[k:k + 2], ' ') for k in range(1, len(w) - 1)]) AS gram FROM (SELECT string_split(en_toxic_comment, ' ') AS w FROM paradetox WHERE en_toxic_comment IS NOT NULL)) GROUP BY gram")
def a1(p):
    w = p.where("en_toxic_comment is not null").select(F.split("en_toxic_comment", " ").alias("w"))
    return w.select(F.explode(F.transform(ar.ngrams(F.col("w"), 3), lambda g: F.array_join(g, " "))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


PUNCT = string.punctuation


@query("a2_normalize", "wildguard", "SELECT item_id, translate(prompt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PUNCT.replace("'", "''") + "', 'abcdefghijklmnopqrstuvwxyz') AS clean FROM wildguard")
def a2(w):
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return w.select("item_id", F.translate("prompt", up + PUNCT, up.lower()).alias("clean"))


@query("a6_word_byte_counts", "documents", "SELECT doc_id, len(regexp_split_to_array(text, '[ \\t\\n\\r]+'))::BIGINT AS n_words, octet_length(encode(text))::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL")
def a6(d):
    return d.where("text is not null").select("doc_id", F.size(F.split("text", "[ \\t\\n\\r]+")).cast("bigint").alias("n_words"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("a8_extract_number", "paradetox", "SELECT pair_id, nullif(regexp_extract('#### ' || pair_id::VARCHAR || ',000', '#### (-?[0-9.,]+)', 1), '') AS raw, replace(regexp_extract('#### ' || pair_id::VARCHAR || ',000', '#### (-?[0-9.,]+)', 1), ',', '') AS number FROM paradetox")
def a8(p):
    raw = F.regexp_extract(F.concat(F.lit("#### "), F.col("pair_id").cast("string"), F.lit(",000")), "#### (-?[0-9.,]+)", 1)
    return p.select("pair_id", F.nullif(raw, F.lit("")).alias("raw"), F.replace(raw, F.lit(","), F.lit("")).alias("number"))


NORM = "list_distinct([w for w in string_split(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' ') if w <> '' and w <> 'the' and w <> 'a' and w <> 'an'])"


@query("a11_answer_f1", "paradetox", f"WITH d AS (SELECT DISTINCT pair_id, {NORM.format(c='en_toxic_comment')} AS x, {NORM.format(c='en_neutral_comment')} AS y FROM paradetox WHERE en_toxic_comment IS NOT NULL AND en_neutral_comment IS NOT NULL), e AS (SELECT *, len(list_intersect(x, y)) AS c FROM d) SELECT pair_id, len(x)::BIGINT AS nx, len(y)::BIGINT AS ny, round(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(x) + len(y)) END, 6) AS f1 FROM e")
def a11(p):
    def norm(c):
        return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " "), lambda w: ~w.isin("", "the", "a", "an"))))

    d = p.where("en_toxic_comment is not null and en_neutral_comment is not null").select("pair_id", norm("en_toxic_comment").alias("x"), norm("en_neutral_comment").alias("y"), "en_toxic_comment", "en_neutral_comment").distinct()
    both = F.size(F.array_intersect("x", "y"))
    return d.select("pair_id", F.size("x").cast("bigint").alias("nx"), F.size("y").cast("bigint").alias("ny"), F.round(F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size("x") + F.size("y"))), 6).alias("f1"))


@query("a12_exact_match", "paradetox", "SELECT split, sum((en_toxic_comment = en_neutral_comment)::INT)::BIGINT AS same, count(*)::BIGINT AS n FROM paradetox GROUP BY split")
def a12(p):
    return p.groupBy("split").agg(F.sum((F.col("en_toxic_comment") == F.col("en_neutral_comment")).cast("int")).alias("same"), F.count("*").alias("n"))


@query("a14_hashes", "wildguard", "SELECT item_id, md5(prompt) AS m, sha256(prompt) AS s FROM wildguard")
def a14(w):
    return w.select("item_id", F.md5("prompt").alias("m"), F.sha2("prompt", 256).alias("s"))


@query("a15_repeated_ngrams", "input_ids", ITEMS + ", e AS (SELECT item_id, [array_to_string(a[k:k + 1], ',') for k in range(1, len(a))] AS g FROM d) SELECT item_id, (len(g) - len(list_distinct(g)))::BIGINT AS repeated FROM e")
def a15(i):
    g = F.transform(ar.ngrams(F.col("a"), 2), lambda x: F.array_join(x.cast("array<string>"), ","))
    return each_item(i, repeated=let(g, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")))


@query("a16_math", "civil_comments", "SELECT comment_id, round(exp(toxicity), 6) AS e, round(ln(toxicity + 1), 6) AS l, ceil(toxicity * 10)::BIGINT AS c, floor(toxicity * 10)::BIGINT AS f, round(sqrt(toxicity), 6) AS s, least(greatest(toxicity, 0.2), 0.8) AS clamp FROM civil_comments WHERE toxicity IS NOT NULL")
def a16(c):
    t = F.col("toxicity")
    return c.where("toxicity is not null").select("comment_id", F.round(F.exp(t), 6).alias("e"), F.round(F.ln(t + 1), 6).alias("l"), F.ceil(t * 10).alias("c"), F.floor(t * 10).alias("f"), F.round(F.sqrt(t), 6).alias("s"), F.least(F.greatest(t, F.lit(0.2)), F.lit(0.8)).alias("clamp"))


@query("a17_json", "events", "SELECT event_id, props::JSON->>'$.page' AS page, json_valid(props) AS valid FROM events")
def a17(e):
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("a18_vocabulary", "input_ids", f"SELECT count(*)::BIGINT AS tokens, max(x)::BIGINT AS most, sum((x = {EOS})::INT)::BIGINT AS ends, sum((x < 0 OR x > 65535)::INT)::BIGINT AS outside FROM (SELECT unnest(input_ids) AS x FROM input_ids)")
def a18(i):
    x = F.col("x")
    return i.select(F.explode("input_ids").alias("x")).agg(F.count("*").alias("tokens"), F.max(x).cast("bigint").alias("most"), F.sum((x == EOS).cast("int")).alias("ends"), F.sum(((x < 0) | (x > 65535)).cast("int")).alias("outside"))


@query("a19_char_tokens", "wildguard", "SELECT item_id, array_to_string([ascii(c)::VARCHAR for c in string_split(prompt, '')], ',') AS ids FROM wildguard WHERE prompt IS NOT NULL")
def a19(w):
    """Characters as ids, over the whole prompt."""
    return w.where("prompt is not null").select("item_id", F.array_join(F.transform(F.filter(F.split("prompt", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("string")), ",").alias("ids"))
