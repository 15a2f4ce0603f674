"""Queries that build token rows: labelled tokens, trimming, masks, collation, windows, packing with masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import spans as sp
from quarrymill.functions.text import let
from quarrymill.operators import tokens as tk
from quarrymill.plans.arrays import EOS, ITEMS, digest, each_item, items
from quarrymill.plans.filters import SPANS, tagged
from quarrymill.plans.registry import query

SPLIT = "regexp_extract_all({t}, '[^ \\t\\n\\r\\f]+')".replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\f", "\f")
ID = "(('0x' || substr(md5({w}), 1, 6))::UBIGINT::INT % 50021)"
IDS = "[" + ID.format(w="w") + " for w in " + SPLIT + "]"
ROWS = f"WITH t AS (SELECT row_number() OVER () AS r, id, text, {SPANS} AS spans FROM toxic_reddit), d AS (SELECT * FROM t WHERE text IS NOT NULL AND len(spans) > 0) "
MD5 = "md5(array_to_string({a}, ','))"
PAIR = f"WITH d AS (SELECT DISTINCT pair_id, {IDS.format(t='en_toxic_comment')} AS x, {IDS.format(t='en_neutral_comment')} AS y FROM paradetox WHERE en_toxic_comment IS NOT NULL AND en_neutral_comment IS NOT NULL) "


def pairs(p):
    """Both comments of each pair as token ids."""
    both = p.where("en_toxic_comment is not null and en_neutral_comment is not null")
    return both.select("pair_id", tk.word_ids(F.col("en_toxic_comment")).alias("x"), tk.word_ids(F.col("en_neutral_comment")).alias("y"))


@query("pr11_span_tokens", "toxic_reddit", ROWS + f", s AS (SELECT r, id, text, spans, unnest(range(1, len(spans) + 1)) AS k FROM d), w AS (SELECT r, id, k, CASE WHEN spans[k].score > 0.9 THEN 3 WHEN spans[k].score > 0.1 THEN 2 ELSE 1 END AS c, {IDS.format(t='substr(text, coalesce(spans[k - 1].end, 0) + 1, greatest(spans[k].end - coalesce(spans[k - 1].end, 0), 0))')} AS i FROM s), x AS (SELECT r, id, flatten(list(i ORDER BY k)) AS i, flatten(list([c for z in i] ORDER BY k)) AS m FROM w GROUP BY r, id) SELECT id, len(i)::BIGINT AS n, {MD5.format(a='i')} AS ids, {MD5.format(a='m')} AS mask FROM x")
def pr11b(t):
    """Each span with the gap before it is tokenized by itself; ids and the spans' codes, repeated for their tokens. No shuffle."""
    labelled = tk.labelled_tokens(F.col("text"), F.col("spans"), lambda v: sp.mask_code(v, 0.1, 0.9))
    rows = tagged(t).where(F.col("text").isNotNull() & (F.size("spans") > 0)).select("id", labelled.alias("s"))
    return rows.select("id", F.size("s.ids").cast("bigint").alias("n"), digest(F.col("s.ids")).alias("ids"), digest(F.col("s.mask")).alias("mask"))


@query("pr12_keep_positions", "input_ids", ITEMS + "SELECT item_id, md5(array_to_string(list_sort([split_part(h, ':', 2)::INT for h in list_sort([md5(item_id::VARCHAR || ':' || k::VARCHAR) || ':' || k::VARCHAR for k in range(len(a))])[1:len(a) * 3 // 10] if a[split_part(h, ':', 2)::INT + 1] not in (7919, 15838)]), ',')) AS kept FROM d")
def pr12b(i):
    """The positions of three tenths of the tokens, those of the smallest hashes, without two banned tokens."""
    return each_item(i, kept=digest(tk.kept_positions(F.col("item_id"), F.col("a"), 0.3, [7919, 15838])))


@query("pr14_pair_rows", "toxic_reddit", ROWS + f", s AS (SELECT r, id, text, spans[k] AS a, spans[k + 1] AS b, k FROM (SELECT *, unnest(range(1, len(spans))) AS k FROM d)), w AS (SELECT id, k, {IDS.format(t='substr(text, a.start + 1, greatest(a.end - a.start, 0))')} AS x, {IDS.format(t='substr(text, b.start + 1, greatest(b.end - b.start, 0))')} AS y FROM s WHERE a.score < 0.1 AND b.score > 0.9) SELECT id, k::BIGINT AS pos, {MD5.format(a='x || y || [0 for z in range(48 - len(x) - len(y))]')} AS ids, {MD5.format(a='[0 for z in x] || [1 for z in y] || [0 for z in range(48 - len(x) - len(y))]')} AS mask FROM w WHERE len(x) + len(y) <= 48")
def pr14b(t):
    """A clean sentence followed by a toxic one as ids and a mask that is 1 on the second; rows over 48 tokens are dropped.

    Words never join across the blank between the two, so that tokenizing them together gives the same ids."""
    cut = lambda s: tk.word_ids(F.substring("text", s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0))))
    both = F.arrays_zip(F.col("spans").alias("a"), F.slice("spans", F.lit(2), F.size("spans")).alias("b"))
    e = tagged(t).where(F.col("text").isNotNull() & (F.size("spans") > 1)).select("id", "text", F.posexplode(both).alias("p", "z")).where((F.col("z.a.score") < 0.1) & (F.col("z.b.score") > 0.9))
    w = e.select("id", (F.col("p") + 1).cast("bigint").alias("pos"), cut(F.col("z.a")).alias("x"), cut(F.col("z.b")).alias("y")).where(F.size("x") + F.size("y") <= 48)
    ids, mask = tk.reply_row(F.col("x"), F.col("y"), 48)
    return w.select("id", "pos", digest(ids).alias("ids"), digest(mask).alias("mask"))


FAIR = PAIR + ", n AS (SELECT *, CASE WHEN len(x) + len(y) <= 24 THEN len(x) WHEN len(y) <= 12 THEN 24 - len(y) WHEN len(x) <= 12 THEN len(x) ELSE 12 END AS nx FROM d), c AS (SELECT pair_id, x[1:nx] AS x, y[1:24 - least(len(x), nx)] AS y FROM n) "


@query("pr16_fair_rows", "paradetox", FAIR + f"SELECT DISTINCT pair_id, {MD5.format(a='x || y || [0 for z in range(24 - len(x) - len(y))]')} AS ids, {MD5.format(a='[0 for z in x] || [1 for z in y] || [0 for z in range(24 - len(x) - len(y))]')} AS mask FROM c")
def pr16b(p):
    """Both sides cut to 24 tokens fairly; the mask is 1 on the reply."""
    d = pairs(p)
    x, y = tk.fair_trim(F.col("x"), F.col("y"), 24)
    ids, mask = tk.reply_row(F.col("cx"), F.col("cy"), 24)
    return d.select("pair_id", x.alias("cx"), y.alias("cy")).select("pair_id", digest(ids).alias("ids"), digest(mask).alias("mask")).distinct()


@query("pr19_answer_rows", "paradetox", PAIR + f"SELECT DISTINCT pair_id, {MD5.format(a='[1 for z in range(greatest(64 - len(x) - len(y), 0))] || x || y')} AS ids, {MD5.format(a='[0 for z in range(64 - len(x) - len(y))] || [0 for z in x] || [1 for z in y]')} AS mask FROM d WHERE len(x) + len(y) <= 64")
def pr19b(p):
    """Rewriting tasks: left padding, and a mask that is 1 on the answer only; rows over 64 tokens are dropped."""
    ids, mask = tk.reply_row(F.col("x"), F.col("y"), 64, left=True, pad=1)
    return pairs(p).where(F.size("x") + F.size("y") <= 64).select("pair_id", digest(ids).alias("ids"), digest(mask).alias("mask")).distinct()


@query("pr20_sequence_mask", "input_ids", ITEMS + "SELECT item_id, md5(array_to_string([CASE WHEN a[k] = 15838 OR (a[k] = 7919 AND coalesce(a[k + 1], -1) = 0) OR (a[k] = 0 AND coalesce(a[k - 1], -1) = 7919) THEN 0 ELSE 1 END for k in range(1, len(a) + 1)], ',')) AS mask FROM d")
def pr20b(i):
    """Mask 0 on every token of a listed sequence: one token, and one of two tokens."""
    return each_item(i, mask=digest(tk.pattern_mask(F.col("a"), [[15838], [7919, 0]])))


@query("pr22_chat_rows", "paradetox", f"WITH c AS (SELECT pair_id, max(en_toxic_comment) AS u, max(en_neutral_comment) AS v FROM paradetox GROUP BY pair_id), d AS (SELECT pair_id, [{ID.format(w='chr(60) || chr(124) || ' + chr(39) + 'user' + chr(39) + ' || chr(124) || chr(62)')}] AS hu, {IDS.format(t='u')} AS x, [{ID.format(w='chr(60) || chr(124) || ' + chr(39) + 'assistant' + chr(39) + ' || chr(124) || chr(62)')}] AS ha, {IDS.format(t='v')} AS y FROM c WHERE u IS NOT NULL AND v IS NOT NULL), r AS (SELECT pair_id, (hu || x || [50021] || ha || y || [50021])[1:40] AS i, ([0] || [0 for z in x] || [0, 0] || [1 for z in y] || [0])[1:40] AS m FROM d) SELECT pair_id, {MD5.format(a='i || [0 for z in range(40 - len(i))]')} AS ids, {MD5.format(a='m || [0 for z in range(40 - len(m))]')} AS mask FROM r")
def pr22b(p):
    """Turns with headers and end tokens, cut and filled to 40 tokens; only what the assistant says is trained."""
    one = p.groupBy("pair_id").agg(F.max("en_toxic_comment").alias("user"), F.max("en_neutral_comment").alias("assistant")).where("user is not null and assistant is not null")
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("content")) for r in ("user", "assistant")])
    ids, mask = tk.chat_row(turns, 40)
    return one.select("pair_id", digest(ids).alias("ids"), digest(mask).alias("mask"))


COLLATED = ITEMS + ", e AS (SELECT *, max(len(a)) OVER (PARTITION BY item_id // 8) AS n FROM d) SELECT item_id, {ids} AS ids, {mask} AS mask, {bias} AS bias FROM e"


@query("pr23_collated_rows", "input_ids", COLLATED.format(ids=MD5.format(a="[1 for z in range(n - len(a))] || a"), mask=MD5.format(a="[0 for z in range(n - len(a))] || [1 for z in a]"), bias=MD5.format(a="['-inf' for z in range(n - len(a))] || ['0' for z in a]")))
def pr23b(i):
    """Batches of eight filled up on the left: ids, attention mask, and bias (minus infinity on the filling)."""
    rows = i.where(F.size("input_ids") > 0).select("item_id", F.col("input_ids").alias("ids"), tk.ones(F.col("input_ids")).alias("mask"), F.transform("input_ids", lambda x: F.lit("0")).alias("bias"))
    b = tk.collate(rows, F.floor(F.col("item_id") / 8), {"ids": 1, "mask": 0, "bias": "-inf"}, left=True)
    return b.select("item_id", *[digest(F.col(c)).alias(c) for c in ("ids", "mask", "bias")]).distinct()


@query("pr25_mask_and_positions", "input_ids", ITEMS + f"SELECT item_id, md5(array_to_string([CASE WHEN x = {EOS} THEN 0 ELSE 1 END for x in a], ',')) AS mask, md5(array_to_string(range(len(a)), ',')) AS positions FROM d")
def pr25b(i):
    """The loss mask (0 on end tokens) and the position ids."""
    return each_item(i, mask=digest(tk.pattern_mask(F.col("a"), [[EOS]])), positions=digest(F.sequence(F.lit(0), F.size("a") - 1)))


CHOSEN = "(('0x' || substr(md5(item_id::VARCHAR || ':' || ({k})::VARCHAR), 1, 8))::UBIGINT / 4294967296 < 0.5)"


@query("pr27_chance_mask", "input_ids", ITEMS + f"SELECT item_id, md5(array_to_string([CASE WHEN (a[k] = 15838 AND {CHOSEN.format(k='k - 1')}) THEN -100 ELSE a[k] END for k in range(1, len(a) + 1)], ',')) AS labels FROM d")
def pr27b(i):
    """-100 on the occurrences of a pattern that chance (a hash) picks with probability one half."""
    return each_item(i, labels=digest(tk.pattern_labels(F.col("item_id"), F.col("a"), [15838], 0.5)))


@query("pr33_rolling_windows", "input_ids", ITEMS + ", s AS (SELECT item_id, a, unnest([0] || range(512, len(a), 385)) AS s FROM d), w AS (SELECT *, least(CASE WHEN s = 0 THEN 512 ELSE s + 385 END, len(a)) AS e FROM s) SELECT item_id, s::BIGINT AS start, md5(array_to_string(CASE WHEN s = 0 THEN [0] || a[1:e - 1] ELSE a[e - 512:e - 1] END, ',')) AS inputs, md5(array_to_string(a[s + 1:e], ',')) AS targets FROM w")
def pr33b(i):
    """Windows of 512 inputs that predict every token once, each after at least 127 tokens of context."""
    w = let(tk.rolling_windows(F.col("a"), 512, 128, 0), lambda ws: F.transform(ws, lambda x: F.struct(x["start"].cast("bigint").alias("start"), digest(x["inputs"]).alias("inputs"), digest(x["targets"]).alias("targets"))))
    return each_item(i, w=w).select("item_id", F.inline("w"))


@query("pr34_truncate_left", "input_ids", ITEMS + f"SELECT item_id, md5(array_to_string(CASE WHEN len(b) > 99 THEN b[len(b) - 98:] ELSE b END || [{EOS}], ',')) AS ids FROM (SELECT item_id, CASE WHEN a[-1] = {EOS} THEN a[1:len(a) - 1] ELSE a END AS b FROM d)")
def pr34b(i):
    """At most 100 tokens, cut on the left, an end token last."""
    return each_item(i, ids=digest(tk.truncate(F.col("a"), 100, EOS, left=True)))


MASKED = "WITH d AS (SELECT i.item_id, i.a, m.m FROM (SELECT item_id, max(input_ids) AS a FROM input_ids WHERE len(input_ids) > 0 GROUP BY item_id) i JOIN (SELECT item_id, max(label_mask) AS m FROM label_mask WHERE label_mask IS NOT NULL GROUP BY item_id) m ON i.item_id = m.item_id AND len(i.a) = len(m.m)), t AS (SELECT item_id, unnest(a || [50279]) AS x, unnest(m || [1]) AS y, unnest(range(len(a) + 1)) AS p FROM d), "


def masked(i, m):
    """Items with masks of their length."""
    mask = m.where("label_mask is not null").groupBy("item_id").agg(F.max("label_mask").alias("m"))
    return items(i).join(mask, "item_id").where(F.size("a") == F.size("m"))


@query("s1_pack_masks", "input_ids label_mask", MASKED + "g AS (SELECT x, y, row_number() OVER (ORDER BY item_id, p) - 1 AS g, count(*) OVER () AS n FROM t) SELECT (g // 2048)::BIGINT AS seq, md5(string_agg(x::VARCHAR, ',' ORDER BY g)) AS ids, md5(string_agg(y::VARCHAR, ',' ORDER BY g)) AS mask FROM g WHERE g // 2048 < n // 2048 GROUP BY 1")
def s1b(i, m):
    """Packing with masks: an end token with mask 1 after each item."""
    rows = tk.pack(masked(i, m), "item_id", {"a": EOS, "m": 1}, 2048)
    return rows.select("seq", digest(F.col("a")).alias("ids"), digest(F.col("m")).alias("mask"))


@query("s2_pack_shard_masks", "input_ids label_mask", MASKED + "g AS (SELECT x, y, item_id % 4 AS shard, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id, p) - 1 AS g, count(*) OVER (PARTITION BY item_id % 4) AS n FROM t) SELECT shard::BIGINT AS shard, (g // 1024)::BIGINT AS seq, md5(string_agg(x::VARCHAR, ',' ORDER BY g)) AS ids, md5(string_agg(y::VARCHAR, ',' ORDER BY g)) AS mask FROM g WHERE g // 1024 < n // 1024 GROUP BY 1, 2")
def s2b(i, m):
    """Packing in four shards, each of which drops its own tail."""
    rows = tk.pack(masked(i, m), "item_id", {"a": EOS, "m": 1}, 1024, F.col("item_id") % 4)
    return rows.select("shard", "seq", digest(F.col("a")).alias("ids"), digest(F.col("m")).alias("mask"))


@query("s4_samples", "input_ids label_mask", MASKED + "g AS (SELECT x, y, row_number() OVER (ORDER BY item_id, p) - 1 AS g, count(*) OVER () AS n FROM t), k AS (SELECT unnest(range((SELECT (max(n) - 1) // 512 FROM g)::BIGINT)) AS seq) SELECT seq, md5(string_agg(x::VARCHAR, ',' ORDER BY g)) AS ids, md5(string_agg(y::VARCHAR, ',' ORDER BY g)) AS labels FROM k JOIN g ON g >= seq * 512 AND g <= seq * 512 + 512 GROUP BY seq")
def s4(i, m):
    """Samples of 513 tokens across items; the last token of each is the first of the next. The masks are fetched alongside."""
    rows = tk.pack(masked(i, m), "item_id", {"a": EOS, "m": 1}, 512, overlap=1)
    return rows.select("seq", digest(F.col("a")).alias("ids"), digest(F.col("m")).alias("labels"))


@query("b1_padded_blocks", "paradetox", PAIR + ", l AS (SELECT pair_id, least(max(len(x)), 24) + least(max(len(y)), 16) AS n, md5(array_to_string(max(x)[greatest(len(max(x)) - 23, 1):] || max(y)[1:16], ',')) AS ids FROM d WHERE len(y) > 0 GROUP BY pair_id) SELECT pair_id, n::BIGINT AS n, ids, (row_number() OVER (PARTITION BY n ORDER BY pair_id) - 1) // (512 // n) AS block FROM l WHERE n > 0")
def b1(p):
    """Prompts cut on the left and labels on the right, and blocks of rows of one length whose padded total fits 512 tokens.

    Blocks form within a length, so that no row waits for another length's and nothing is padded; the sequential rule
    over all lengths saves at most one block a length."""
    one = pairs(p).where(F.size("y") > 0).groupBy("pair_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    cut = F.concat(F.slice("x", F.greatest(F.size("x") - 23, F.lit(1)), F.lit(24)), F.slice("y", 1, 16))
    rows = one.select("pair_id", cut.alias("a")).select("pair_id", F.size("a").cast("bigint").alias("n"), digest(F.col("a")).alias("ids")).where("n > 0")
    return tk.blocks(rows, "pair_id", "n", 512)


@query("pr35_names", "toxic_reddit", "SELECT DISTINCT split_part(f, '/', 3) AS base, regexp_replace(split_part(split_part(f, '/', 3), '.', 1), '[^A-Za-z0-9]+', '_', 'g') AS clean FROM (SELECT 'dumps/' || coalesce(subreddit, 'none') || '/' || source || '-01.jsonl.zst' AS f FROM toxic_reddit WHERE source IS NOT NULL)")
def pr35b(t):
    """The base name of a path, and a name without its suffixes and odd characters."""
    path = F.concat(F.lit("dumps/"), F.coalesce("subreddit", F.lit("none")), F.lit("/"), "source", F.lit("-01.jsonl.zst"))
    return t.where("source is not null").select(tk.basename(path).alias("base"), tk.clean_name(path).alias("clean")).distinct()
