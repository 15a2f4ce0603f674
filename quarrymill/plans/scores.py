"""Queries of whole score families: choices, likelihoods, labels, references, blending, bootstrap and BLEU."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import arrays as ar
from quarrymill.operators import measures as ms
from quarrymill.operators import scoring as op
from quarrymill.operators import sequential as sq
from quarrymill.operators import tagging
from quarrymill.operators import tokens as tk
from quarrymill.plans.filters import TAGGED, tagged
from quarrymill.plans.measures import KINDS, PRED, predictions
from quarrymill.plans.registry import query

CH = "WITH c AS (SELECT l_orderkey AS doc, l_linenumber - 1 AS cont, -l_extendedprice / 10000 AS ll, l_quantity AS length, -l_tax * 10 AS dc, (l_orderkey % 3)::INT AS label FROM lineitem WHERE l_linenumber <= 3 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1), t AS (SELECT doc, count(*) AS k, arg_max(cont, ll * 1000 - cont * 1e-7) AS acc, arg_max(cont, ll / length * 1000 - cont * 1e-7) AS len_norm, arg_max(cont, (ll - dc) * 1000 - cont * 1e-7) AS pmi_dc, max(label) AS label, max(CASE WHEN cont = label THEN -ll END) AS loss FROM c GROUP BY doc HAVING count(*) = 3) "


def choices(x):
    """The first three line items of an order as choices 0, 1, 2: a log-likelihood, a length, a domain likelihood, and a label."""
    return x.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("cont"), (-F.col("l_extendedprice") / 10000).alias("ll"), F.col("l_quantity").alias("length"), (-F.col("l_tax") * 10).alias("dc"), (F.col("l_orderkey") % 3).cast("int").alias("label"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


@query("agg20_choice_types", "lineitem", CH + "SELECT count(*)::BIGINT AS documents, round(avg((acc = label)::INT), 6) AS acc, round(avg((len_norm = label)::INT), 6) AS len_norm, round(avg((pmi_dc = label)::INT), 6) AS pmi_dc, round(avg(loss), 6) AS ce_loss, round(2.0 * sum((acc = 0 AND label = 0)::INT) / (sum((acc = 0)::INT) + sum((label = 0)::INT)), 6) AS f1 FROM t")
def agg20b(x):
    """Multiple-choice metrics of all types; documents without all three choices don't count."""
    m = op.choice_metrics(op.choice_table(choices(x), "doc", "cont", 3, [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]))
    return m.select("documents", *[F.round(c, 6).alias(c) for c in ("acc", "len_norm", "pmi_dc", "ce_loss", "f1")])


@query("agg29_truthfulness", "lineitem", "WITH q AS (SELECT l_orderkey, l_linenumber AS c, -l_extendedprice / 10000 AS ll, l_returnflag <> 'R' AS t FROM lineitem), p AS (SELECT l_orderkey, arg_max(c, ll * 1000 - c * 1e-7) = min(CASE WHEN t THEN c END) AS mc1, sum(CASE WHEN t THEN exp(ll) ELSE 0 END) / sum(exp(ll)) AS mc2, max(CASE WHEN t THEN ll END) - max(CASE WHEN NOT t THEN ll END) AS diff FROM q GROUP BY l_orderkey) SELECT round(avg(mc1::INT), 6) AS mc1, round(avg(mc2), 6) AS mc2, round(avg(diff), 6) AS diff, round(avg((diff > 0)::INT), 6) AS acc FROM p")
def agg29b(x):
    per = op.truthfulness(-F.col("l_extendedprice") / 10000, F.col("l_returnflag") != "R", F.col("l_linenumber"))
    q = x.groupBy("l_orderkey").agg(*[v.alias(k) for k, v in per.items()])
    return q.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("mc1", "mc2", "diff", "acc")])


UNI = "WITH w AS (SELECT doc_id, coalesce(origin, 'none') AS origin, unnest(string_split(text, ' ')) AS w, strlen(text)::DOUBLE / len(string_split(text, ' ')) AS b FROM documents WHERE length(text) > 0), n AS (SELECT w, ln(count(*) / (SELECT count(*) FROM w)::DOUBLE) AS l FROM w GROUP BY w), s AS (SELECT doc_id, any_value(origin) AS origin, sum(l) AS ll, count(*) AS words, sum(b) AS bytes FROM w JOIN n USING (w) GROUP BY doc_id) "


def unigrams(d):
    return op.unigram_likelihoods(d, "doc_id", "text").join(d.select("doc_id", F.coalesce("origin", F.lit("none")).alias("origin")), "doc_id")


@query("agg23_token_perplexity", "documents", UNI + "SELECT origin, round(exp(-sum(ll) / sum(words)), 3) AS ppl FROM s GROUP BY origin")
def agg23b(d):
    """Token perplexity by sub-domain, under the corpus' word frequencies."""
    return unigrams(d).groupBy("origin").agg(F.round(op.weighted_perplexity(F.col("ll"), F.col("words")), 3).alias("ppl"))


@query("t16_rolling_perplexity", "documents", UNI + "SELECT round(exp(-sum(ll) / sum(words)), 3) AS word_perplexity, round(exp(-sum(ll) / sum(bytes)), 5) AS byte_perplexity, round(-sum(ll) / sum(bytes) / ln(2), 5) AS bits_per_byte FROM s")
def t16b(d):
    m = op.likelihood_metrics(F.col("ll"), F.col("words"), F.col("bytes"))
    return unigrams(d).agg(*[F.round(v, 3 if k == "word_perplexity" else 5).alias(k) for k, v in m.items()])


@query("agg24_aggregations", "documents", UNI + "SELECT round(avg(ll / words), 5) AS mean, round(sum(ll / words * bytes) / sum(bytes), 5) AS weighted_mean, round(exp(-avg(ll / words)), 3) AS perplexity, round(exp(-sum(ll) / sum(bytes)), 5) AS weighted_perplexity, round(max(ll / words), 5) AS best FROM s")
def agg24b(d):
    """Mean, weighted mean, perplexity, weighted perplexity and maximum of the documents' scores."""
    x, b = F.col("ll") / F.col("words"), F.col("bytes")
    return unigrams(d).agg(F.round(F.avg(x), 5).alias("mean"), F.round(op.weighted_mean(x, b), 5).alias("weighted_mean"), F.round(F.exp(-F.avg(x)), 3).alias("perplexity"), F.round(op.weighted_perplexity(F.col("ll"), b), 5).alias("weighted_perplexity"), F.round(F.max(x), 5).alias("best"))


LONG = "WITH c AS (SELECT DISTINCT * EXCLUDE text FROM civil_comments), l AS (" + " UNION ALL ".join(f"SELECT comment_id, toxicity, '{k}' AS label, {k} >= 0.3 AS y, toxicity >= {0.4 + 0.05 * i:.2f} AS p FROM c WHERE {k} IS NOT NULL AND toxicity IS NOT NULL" for i, k in enumerate(KINDS)) + ") "


def labels(c):
    one = c.select("comment_id", "toxicity", *KINDS).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (F.col(k) >= 0.3).alias("y"), (F.col("toxicity") >= round(0.4 + 0.05 * i, 2)).alias("p")) for i, k in enumerate(KINDS)])).alias("k")
    return one.select("comment_id", each).select("comment_id", "k.*").where("y is not null and p is not null")


@query("agg15_label_f1", "civil_comments", LONG + "SELECT label, round(coalesce(2.0::DOUBLE * sum((y AND p)::INT) / nullif(sum(y::INT) + sum(p::INT), 0), 0), 6) AS f1 FROM l GROUP BY label")
def agg15b(c):
    return op.multi_label(labels(c), "comment_id", "label")[0].select("label", F.round("f1", 6).alias("f1"))


@query("agg15_label_totals", "civil_comments", LONG + ", s AS (SELECT label, sum((y AND p)::INT) AS tp, sum(y::INT) AS g, sum(p::INT) AS s FROM l GROUP BY label), e AS (SELECT avg(ok::INT) AS exact_match FROM (SELECT comment_id, bool_and(y = p) AS ok FROM l GROUP BY comment_id)) SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(g + s, 0), 0)), 6) AS macro_f1, round(2.0::DOUBLE * sum(tp) / (sum(g) + sum(s)), 6) AS micro_f1, round(max(exact_match), 6) AS exact_match FROM s, e")
def agg15c(c):
    t = op.multi_label(labels(c), "comment_id", "label")[1]
    return t.select(*[F.round(x, 6).alias(x) for x in ("macro_f1", "micro_f1", "exact_match")])


@query("agg16_accuracy_and_auc", "civil_comments", PRED + ", g AS (SELECT *, (comment_id % 2)::BIGINT AS flag FROM p), a AS (SELECT flag, avg((y = (s >= 0.5))::INT) AS acc FROM g GROUP BY GROUPING SETS ((flag), ())), u AS (SELECT x.flag, sum(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM g x JOIN g z ON x.y AND NOT z.y AND x.flag = z.flag GROUP BY x.flag UNION ALL SELECT NULL, sum(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0.0 END) / count(*) FROM g x JOIN g z ON x.y AND NOT z.y) SELECT a.flag, round(acc, 6) AS accuracy, round(auc, 6)::DOUBLE AS auc FROM a JOIN u ON a.flag IS NOT DISTINCT FROM u.flag")
def agg16b(c):
    """Accuracy and area under the curve of each value of a flag and of all rows."""
    p = predictions(c).withColumn("flag", (F.col("comment_id") % 2).cast("bigint"))
    right = F.avg((F.col("y") == (F.col("s") >= 0.5)).cast("int"))
    acc = p.rollup("flag").agg(right.alias("accuracy"))
    auc = ms.roc_auc(p, "y", "s", ["flag"]).unionByName(ms.roc_auc(p, "y", "s").withColumn("flag", F.lit(None).cast("bigint")))
    return acc.join(auc, acc["flag"].eqNullSafe(auc["flag"])).select(acc["flag"], F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"))


BAGS = "[w for w in string_split(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' ') if w <> '' and w <> 'the' and w <> 'a' and w <> 'an']"
F1 = "CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum([least(len(list_filter({x}, lambda v: v = w)), len(list_filter({y}, lambda v: v = w))) for w in list_distinct({x})]), 0) / (len({x}) + len({y})) END"


@query("t12_best_f1", "paradetox", f"WITH d AS (SELECT pair_id, {BAGS.format(c='en_toxic_comment')} AS x, {BAGS.format(c='en_neutral_comment')} AS y FROM paradetox WHERE en_toxic_comment IS NOT NULL AND en_neutral_comment IS NOT NULL) SELECT pair_id, round(max({F1.format(x='x', y='y')}), 6) AS f1, bool_or(x = y) AS em FROM d GROUP BY pair_id")
def t12(p):
    """Of several references the best F1 on word bags, and whether any is equal after normalisation."""
    x, y = op.answer_words(F.col("en_toxic_comment")), op.answer_words(F.col("en_neutral_comment"))
    d = p.where("en_toxic_comment is not null and en_neutral_comment is not null").select("pair_id", x.alias("x"), y.alias("y"))
    return d.groupBy("pair_id").agg(F.round(F.max(op.bag_f1(F.col("x"), F.col("y"))), 6).alias("f1"), F.bool_or(F.col("x") == F.col("y")).alias("em"))


@query("t13_split_scores", "paradetox", f"WITH d AS (SELECT split, pair_id % 3 = 0 AS yes_no, {BAGS.format(c='en_toxic_comment')} AS x, {BAGS.format(c='en_neutral_comment')} AS y FROM paradetox WHERE en_toxic_comment IS NOT NULL AND en_neutral_comment IS NOT NULL), s AS (SELECT split, yes_no, len(x) > 12 AS g, len(y) > 12 AS p, {F1.format(x='x', y='y')} AS f FROM d) SELECT split, round(2.0::DOUBLE * sum((yes_no AND g AND p)::INT) / nullif(sum((yes_no AND g)::INT) + sum((yes_no AND p)::INT), 0), 6) AS yes_no_f1, round(avg(CASE WHEN NOT yes_no THEN f END), 6) AS abstractive_f1 FROM s GROUP BY split")
def t13(p):
    """Yes/no questions by F1 of yes (here: over twelve words), the others by F1 on word bags."""
    x, y = op.answer_words(F.col("en_toxic_comment")), op.answer_words(F.col("en_neutral_comment"))
    d = p.where("en_toxic_comment is not null and en_neutral_comment is not null").select("split", (F.col("pair_id") % 3 == 0).alias("q"), x.alias("x"), y.alias("y"))
    s = d.select("split", "q", (F.size("x") > 12).alias("g"), (F.size("y") > 12).alias("a"), op.bag_f1(F.col("x"), F.col("y")).alias("f"))
    q, g, a = F.col("q"), F.col("g"), F.col("a")
    return s.groupBy("split").agg(F.round(F.try_divide(2.0 * F.count_if(q & g & a), F.count_if(q & g) + F.count_if(q & a)), 6).alias("yes_no_f1"), F.round(F.avg(F.when(~q, F.col("f"))), 6).alias("abstractive_f1"))


@query("t9_candidate_scores", "lineitem", "WITH b AS (SELECT l_orderkey, arg_max(l_linenumber, -l_extendedprice * 1000 - l_linenumber * 1e-7) AS pick FROM lineitem GROUP BY l_orderkey) SELECT b.l_orderkey, pick::INT AS pick, max((x.l_linenumber = pick AND x.l_returnflag = 'N')::INT) AS em FROM b JOIN lineitem x USING (l_orderkey) GROUP BY b.l_orderkey, pick")
def t9b(x):
    """The best candidate of each document, and whether it is one of the gold set's (those of return flag N). One pass: the
    gold set travels with the aggregate as a set of choices."""
    n = F.col("l_linenumber")
    per = x.groupBy("l_orderkey").agg(op.best_choice(-F.col("l_extendedprice"), n).cast("int").alias("pick"), F.collect_set(F.when(F.col("l_returnflag") == "N", n)).alias("gold"))  # choices of one document
    return per.select("l_orderkey", "pick", F.array_contains("gold", F.col("pick")).cast("int").alias("em"))


@query("agg8_shifted_perplexity", "input_ids label_mask", "WITH d AS (SELECT i.item_id, i.a, m.m FROM (SELECT item_id, max(input_ids) AS a FROM input_ids WHERE len(input_ids) > 0 GROUP BY item_id) i JOIN (SELECT item_id, max(label_mask) AS m FROM label_mask WHERE label_mask IS NOT NULL GROUP BY item_id) m ON i.item_id = m.item_id AND len(i.a) = len(m.m)), t AS (SELECT unnest([(x % 97) / 20.0::DOUBLE for x in a[1:len(a) - 1]]) AS loss, unnest(m[2:]) AS c FROM d WHERE len(a) > 1) SELECT round(exp(sum(CASE WHEN c = 1 THEN loss ELSE 0 END) / sum((c = 1)::INT)), 4) AS ppl FROM t")
def agg8b(i, m):
    """Masked perplexity with labels shifted by one: the loss at a token belongs to the token after it, and its mask counts."""
    mask = m.where("label_mask is not null").groupBy("item_id").agg(F.max("label_mask").alias("m"))
    d = i.where(F.size("input_ids") > 1).groupBy("item_id").agg(F.max(F.transform("input_ids", lambda x: x % 97 / 20.0)).alias("loss")).join(mask, "item_id").where(F.size("loss") == F.size("m"))
    n = F.size("loss") - 1
    t = d.select(F.inline(F.arrays_zip(F.slice("loss", F.lit(1), n).alias("loss"), F.slice("m", F.lit(2), n).alias("c"))))
    return t.agg(F.round(F.exp(F.sum(F.when(F.col("c") == 1, F.col("loss")).otherwise(0)) / F.count_if(F.col("c") == 1)), 4).alias("ppl"))


@query("agg10_span_loss", "toxic_reddit", TAGGED + ", d AS (SELECT DISTINCT id, text, spans FROM t WHERE text IS NOT NULL AND len(spans) > 0), w AS (SELECT id, spans, string_split(text, ' ') AS w FROM d), r AS (SELECT id, spans, unnest(w) AS w, unnest([coalesce(list_sum([len(x) + 1 for x in w[1:k - 1]]), 0) for k in range(1, len(w) + 1)]) AS s, unnest(range(len(w))) AS k FROM w), l AS (SELECT id, k, s, s + length(w) AS e, spans, lag(length(w)) OVER (PARTITION BY id ORDER BY k) / 10.0::DOUBLE AS loss FROM r) SELECT id, count(*)::BIGINT AS tokens, round(avg(loss), 6) AS loss FROM l WHERE k > 0 AND len([x for x in spans if x.score > 0.7 AND x.start < e AND x.end > s]) > 0 GROUP BY id")
def agg10b(t):
    """Mean loss of the tokens (words) whose characters touch a toxic span, the loss being that of the token before. No join."""
    w = F.split("text", " ")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("loss"))

    def step(a, x):
        end = a["at"] + F.length(x)
        touch = (a["k"] > 0) & F.exists("hot", lambda s: (s["start"] < end) & (s["end"] > a["at"]))
        return F.struct((end + 1).alias("at"), (a["k"] + 1).alias("k"), F.length(x).alias("last"), (a["n"] + F.when(touch, 1).otherwise(0)).alias("n"), (a["loss"] + F.when(touch, a["last"] / 10.0).otherwise(0.0)).alias("loss"))

    rows = tagged(t).where(F.col("text").isNotNull() & (F.size("spans") > 0)).withColumn("hot", F.filter("spans", lambda s: s["score"] > 0.7))
    r = rows.select("id", F.aggregate(w, start, step).alias("r")).distinct().where("r.n > 0")
    return r.select("id", F.col("r.n").cast("bigint").alias("tokens"), F.round(F.col("r.loss") / F.col("r.n"), 6).alias("loss"))


@query("agg4_text_ngrams", "documents", "SELECT k::INT AS k, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, gram) AS r FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, gram, count(*)::BIGINT AS n FROM (SELECT unnest([array_to_string(w[j:j + {k - 1}], ' ') for j in range(1, len(w) - {k} + 2)]) AS gram FROM (SELECT string_split(substr(text, strpos(text, ',') + 1), ' ') AS w FROM documents WHERE text IS NOT NULL)) GROUP BY gram" for k in (1, 2, 4, 8)) + ")) WHERE r <= 10")
def agg4b(d):
    """The most frequent word n-grams of lengths 1, 2, 4 and 8 of what stands behind the first comma."""
    w = d.where("text is not null").select(F.split(F.expr("substring(text, locate(',', text) + 1)"), " ").alias("w"))

    def grams(k):
        return F.transform(ar.ngrams(F.col("w"), k), lambda g: F.struct(F.lit(k).alias("k"), F.array_join(g, " ").alias("gram")))

    counts = w.select(F.explode(F.concat(*[grams(k) for k in (1, 2, 4, 8)])).alias("g")).groupBy("g.k", "g.gram").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "gram"))).where("r <= 10").drop("r")


@query("agg26_bootstrap", "civil_comments", "WITH e AS (SELECT comment_id, toxicity, unnest(range(1, 201)) AS k FROM civil_comments WHERE toxicity IS NOT NULL), u AS (SELECT *, ('0x' || substr(md5(k::VARCHAR || ':' || comment_id::VARCHAR), 1, 8))::UBIGINT / 4294967296 AS u FROM e), w AS (SELECT *, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.996340 THEN 4 ELSE 5 END AS w FROM u), m AS (SELECT k, sum(w * toxicity) / sum(w) AS m FROM w GROUP BY k) SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS standard_error FROM m")
def agg26(c):
    """Bootstrap standard error of the mean with Poisson weights from hashes: one pass of 200 pairs of sums, no row is copied."""
    m = sq.poisson_means(c.where("toxicity is not null"), F.col("comment_id"), F.col("toxicity"), 200)
    return m.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("standard_error"))


@query("l16_blending", "toxic_reddit", "WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM toxic_reddit WHERE source IS NOT NULL GROUP BY source), w AS (SELECT list(n / (SELECT sum(n) FROM c)::DOUBLE ORDER BY source) AS w, list(source ORDER BY source) AS s FROM c), r(i, pick, taken) AS (SELECT -1, 0, [0 for x in w] FROM w UNION ALL SELECT i + 1, p, [taken[k] + (k = p)::INT for k in range(1, len(taken) + 1)] FROM (SELECT i, taken, list_position(e, list_max(e)) AS p FROM (SELECT i, taken, [w[k] * greatest(i + 1, 1) - taken[k] for k in range(1, len(w) + 1)] AS e FROM r, w WHERE i < 399))) SELECT i::BIGINT AS sample, s[pick] AS source, (taken[pick] - 1)::BIGINT AS nth FROM r, w WHERE i >= 0")
def l16(t):
    """The first 400 blended samples: the source of each and which of its records it is."""
    return sq.blended_index(t, "source", 400)


NG = "[array_to_string({t}[k:k + {m}], ' ') for k in range(1, len({t}) - {m} + 1)]"
CLIP = "coalesce(list_sum([least(len(list_filter({x}, lambda v: v = g)), len(list_filter({y}, lambda v: v = g))) for g in list_distinct({x})]), 0)"


@query("agg30_bleu", "paradetox", "WITH d AS (SELECT [w for w in string_split_regex(en_neutral_comment, '[\\s\\p{Z}]+') if w <> ''] AS x, [w for w in string_split_regex(en_toxic_comment, '[\\s\\p{Z}]+') if w <> ''] AS y FROM paradetox WHERE en_neutral_comment IS NOT NULL AND en_toxic_comment IS NOT NULL), n AS (SELECT len(x) AS lx, len(y) AS ly, " + ", ".join(f"{NG.format(t='x', m=m)} AS x{m}, {NG.format(t='y', m=m)} AS y{m}" for m in range(4)) + " FROM d), s AS (SELECT sum(lx) AS c, sum(ly) AS r, " + ", ".join(f"sum({CLIP.format(x=f'x{m}', y=f'y{m}')})::DOUBLE AS h{m}, sum(len(x{m}))::DOUBLE AS t{m}" for m in range(4)) + " FROM n) SELECT round(100 * exp(least(0.0, 1 - r::DOUBLE / c) + (" + " + ".join(f"ln(h{m} / t{m})" for m in range(4)) + ") / 4), 6) AS bleu, c::BIGINT AS words FROM s")
def agg30(p):
    return sq.corpus_bleu(p, "en_neutral_comment", "en_toxic_comment").select(F.round("bleu", 6).alias("bleu"), "words")


@query("agg30_chrf_ter", "paradetox")
def agg30c(p):
    """chrF, translation edit rate and mean sentence BLEU of the same pairs."""
    return sq.text_distances(p, "en_neutral_comment", "en_toxic_comment")


@query("b4_judged", "civil_comments", "SELECT round(avg(starts_with(lower(ltrim(text)), 'the')::INT), 6) AS right, round(avg(starts_with(lower(ltrim(text)), 'you')::INT), 6) AS wrong, round(avg(contains(lower(ltrim(text)), ' part')::INT), 6) AS partial, round(avg((contains(lower(ltrim(text)), 'teacher') OR contains(lower(ltrim(text)), 'nurse'))::INT), 6) AS mentions FROM civil_comments WHERE text IS NOT NULL")
def b4b(c):
    m = op.judge_rates(F.col("text"), "the", "you", " part", F.array(F.lit("teacher"), F.lit("nurse")))
    return c.where("text is not null").agg(*[F.round(v, 6).alias(k) for k, v in m.items()])


@query("b10_object_hash", "wildguard", "SELECT item_id, md5('{\"item_id\":' || item_id::VARCHAR || ',\"split\":' || CASE WHEN split IS NULL THEN 'null' ELSE '\"' || split || '\"' END || ',\"adversarial\":' || coalesce(adversarial::VARCHAR, 'null') || '}') AS hash FROM wildguard")
def b10(w):
    return w.select("item_id", op.object_hash(F.col("item_id"), F.col("split"), F.col("adversarial")).alias("hash"))


@query("t20_contamination_texts", "wildguard paradetox", "SELECT DISTINCT 'wildguard' AS task, item_id::VARCHAR AS item, prompt || ' ' || coalesce(prompt_harm_label, '') AS query_text FROM wildguard WHERE prompt IS NOT NULL UNION ALL SELECT DISTINCT 'paradetox', pair_id::VARCHAR, en_toxic_comment FROM paradetox WHERE en_toxic_comment IS NOT NULL AND split = 'test'")
def t20(w, p):
    """The text of each task's items that is looked for in training data; feeds j7_contaminated_items' join."""
    a = w.where("prompt is not null").select(F.lit("wildguard").alias("task"), F.col("item_id").cast("string").alias("item"), F.concat("prompt", F.lit(" "), F.coalesce("prompt_harm_label", F.lit(""))).alias("query_text"))
    b = p.where("en_toxic_comment is not null and split = 'test'").select(F.lit("paradetox").alias("task"), F.col("pair_id").cast("string").alias("item"), F.col("en_toxic_comment").alias("query_text"))
    return a.distinct().unionByName(b.distinct())


@query("a9_math_answers", "paradetox", "WITH a AS (SELECT pair_id, '\\left( \\tfrac' || (pair_id % 7)::VARCHAR || (pair_id % 9 + 1)::VARCHAR || ' \\right) \\text{ cm} + \\sqrt' || (pair_id % 5)::VARCHAR || '\\%' AS x FROM (SELECT DISTINCT pair_id FROM paradetox)) SELECT pair_id, regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '\\\\text\\{[^}]*\\}', '', 'g'), '\\left', ''), '\\right', ''), '\\%', ''), ' ', ''), '\\\\[td]?frac(\\d)(\\d)', '\\\\frac{\\1}{\\2}', 'g'), '\\\\sqrt(\\d)', '\\\\sqrt{\\1}', 'g') AS answer FROM a")
def a9(p):
    """Answers in mathematical notation, normalised: units, sizes of brackets, percent signs and blanks go, braces are put in."""
    k = F.col("pair_id")
    x = F.concat(F.lit("\\left( \\tfrac"), (k % 7).cast("string"), (k % 9 + 1).cast("string"), F.lit(" \\right) \\text{ cm} + \\sqrt"), (k % 5).cast("string"), F.lit("\\%"))
    return p.select("pair_id").distinct().select("pair_id", tk.math_answer(x).alias("answer"))


@query("a5_wiki_text", "paradetox", "SELECT DISTINCT pair_id, regexp_replace(regexp_replace(regexp_replace(replace(replace('( ' || en_neutral_comment || ' ) 1 @,@ 000 @-@ fold ; done .', ' @,@ ', ','), ' @-@ ', '-'), '\\( (.*) \\)', '(\\1)'), ' ([;:,.!?])', '\\1', 'g'), '  +', ' ', 'g') AS text FROM paradetox WHERE en_neutral_comment IS NOT NULL AND NOT contains(en_neutral_comment, chr(10))")
def a5b(p):
    """Tokenized text put together again: number and hyphen marks, brackets, blanks before punctuation."""
    c = F.concat(F.lit("( "), "en_neutral_comment", F.lit(" ) 1 @,@ 000 @-@ fold ; done ."))
    return p.where(F.col("en_neutral_comment").isNotNull() & ~F.contains("en_neutral_comment", F.lit("\n"))).select("pair_id", tk.detokenized(c).alias("text")).distinct()


@query("a1_gram_ranges", "wildguard", "WITH w AS (SELECT DISTINCT item_id, string_split(prompt, ' ') AS w FROM wildguard WHERE prompt IS NOT NULL), s AS (SELECT item_id, w, [coalesce(list_sum([len(x) + 1 for x in w[1:k - 1]]), 0) for k in range(1, len(w) + 1)] AS s FROM w) SELECT item_id, md5(array_to_string([s[k]::BIGINT::VARCHAR || '-' || (s[k + 4] + len(w[k + 4]))::BIGINT::VARCHAR for k in range(1, len(w) - 3)], ',')) AS ranges FROM s")
def a1b(w):
    """The character ranges of all word 5-grams of a prompt."""
    r = tk.gram_ranges(F.col("prompt"), 5)
    return w.where("prompt is not null").select("item_id", F.md5(F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")).alias("ranges")).distinct()


@query("a19_round_trip", "documents", "SELECT count(*)::BIGINT AS texts, count(*)::BIGINT AS same FROM documents WHERE text IS NOT NULL")
def a19b(d):
    """Encoding and decoding by a public byte-level vocabulary gives every text back."""
    ids = sq.encoded(F.col("text"))
    r = d.where("text is not null").select("text", ids.alias("ids")).select("text", sq.decoded(F.col("ids")).alias("back"))
    return r.agg(F.count("*").alias("texts"), F.count_if(F.col("text") == F.col("back")).alias("same"))


@query("x6_tagged", "documents", "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(l) AS line, unnest([coalesce(list_sum([length(x) + 1 for x in l[1:k - 1]]), 0) for k in range(1, len(l) + 1)])::BIGINT AS s FROM d) SELECT doc_id, s AS start, s + length(line)::BIGINT AS end, round(len([w for w in string_split(lower(line), ' ') if w in ('you', 'your', 'yours', 'u')])::DOUBLE / len(string_split(lower(line), ' ')), 6) AS score FROM s")
def x6(d):
    """The spans that a registered tagger attaches: lines and their share of second-person words."""
    t = tagging.tagged(d.where("text is not null").select("doc_id", "text"), "text", ["second_person"]).select("doc_id", F.inline("second_person"))
    return t.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.round("score", 6).alias("score"))
