"""Small hand-made cases: spans, arrays, orders, sequential operators, sources, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import arrays, spans, text
from quarrymill.operators import measures, ordering, sequential
from quarrymill.sources import readers, sinks
from quarrymill.streaming import running


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_excision_and_shift(spark):
    raw = [[0.0, 6.0, 0.1], [7.0, 13.0, 0.9], [14.0, 17.0, 0.2]]
    df = spark.createDataFrame([("Aa bb. Cc dd. Ee.", raw)], "text string, raw array<array<double>>").withColumn("s", spans.typed(F.col("raw")))
    row = df.select(spans.excise(F.col("text"), F.col("s"), 0.5).alias("t"), spans.shifted(F.col("s"), 0.5).alias("k"), spans.excise(F.col("text"), F.col("s"), 0.5, inclusive_end=False).alias("e")).first()
    assert row.t == "Aa bb. Ee." and row.e == "Aa bb.  Ee."
    assert [tuple(k) for k in row.k] == [(0, 6, 0.1), (7, 10, 0.2)]


@pytest.mark.parametrize("limit, left", [(2.0, "ab. cd."), (-1.0, "")])
def test_excision_of_all_and_none(spark, limit, left):
    df = spark.createDataFrame([("ab. cd.", [[0.0, 3.0, 0.1], [4.0, 7.0, 0.9]])], "text string, raw array<array<double>>")
    assert df.select(spans.excise(F.col("text"), spans.typed(F.col("raw")), limit)).first()[0] == left


def test_typed_spans_drop_what_is_malformed(spark):
    assert one(spark, [[1.0, 2.0, 0.5], None, [1.0], [None, 2.0, 0.1]], "array<array<double>>", F.size(spans.typed(F.col("x")))) == 1
    assert one(spark, None, "array<array<double>>", spans.typed(F.col("x"))) is None


def test_codes_at_the_thresholds(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.11, 0.9, 0.91)], "v double")
    assert [tuple(r) for r in df.select(spans.label(F.col("v"), 0.1, 0.9), spans.mask_code(F.col("v"), 0.1, 0.9)).collect()] == [(-1, 1), (-1, 2), (-1, 2), (1, 3)]


def test_overlapping_hits_and_long_patterns(spark):
    assert one(spark, [1, 1, 1, 1], "array<int>", arrays.hits(F.col("x"), [1, 1, 1])) == [0, 1]
    assert one(spark, [1], "array<int>", arrays.hits(F.col("x"), [1, 2])) == []


def test_padding(spark):
    assert one(spark, [4, 5], "array<int>", arrays.pad(F.col("x"), 4, 0)) == [4, 5, 0, 0]
    assert one(spark, [4, 5], "array<int>", arrays.pad(F.col("x"), 4, 0, left=True)) == [0, 0, 4, 5]
    assert one(spark, [4, 5, 6], "array<int>", arrays.pad(F.col("x"), 2, 0)) == [4, 5]


def test_words(spark):
    assert one(spark, " It's  a\tTEST-case… ", "string", text.words(F.col("x"))) == ["its", "a", "testcase"]


def test_positions_and_running_sums_are_global(spark):
    df = spark.range(500)
    pos = {r.id: r.pos for r in ordering.numbered(df, ordering.hash_order(F.col("id"), 1)).collect()}
    assert sorted(pos.values()) == list(range(500)) and pos != {k: k for k in range(500)}
    run = {r.id: r.g for r in ordering.running(df, F.col("id"), ["id"], F.floor(F.col("id") / 37), "g").collect()}
    assert run == {k: k * (k - 1) // 2 for k in range(500)}


def test_auc_of_ties_and_one_class(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 0.9), (False, 0.1)], "y boolean, s double")
    assert measures.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    assert measures.roc_auc(df.where("y"), "y", "s").first().auc is None


def test_repeats():
    assert sequential.repeats(np.array([1, 2] * 10), 2) >= 9
    assert sequential.repeats(np.array([1, 2, 3]), 5) == 1


def test_blending_stays_within_one_of_the_weights():
    got = sequential.blending([0.5, 0.3, 0.2], 1000)
    assert all(abs(got.count(k) - 1000 * w) <= 1 for k, w in enumerate([0.5, 0.3, 0.2]))
    assert got[:4] == [0, 1, 2, 0]  # the shares of the first two samples are those of one


def test_alignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (6, 4)):
        t = r.random((n, m)).round(2)
        a = t if n <= m else t.T
        best = max(sum(a[i, p[i]] for i in range(len(a))) for p in permutations(range(a.shape[1]), len(a)))
        assert sequential.best_alignment(t) == pytest.approx(best)
    assert sequential.best_alignment(r.random((60, 60))) > 40  # a long answer ends at once


def test_text_distances(spark):
    df = spark.createDataFrame([("the lamp is in the yard", "the lamp is in the yard"), (None, "x")], "a string, b string")
    assert tuple(sequential.text_distances(df, "a", "b").first()) == (pytest.approx(100), 0.0, pytest.approx(1))
    assert sequential.edit_rate_parts("c d a b".split(), "a b c d".split()) == 1
    x, y = "a b c d e f".split(), "b c x d f g".split()
    assert sequential._plain_edits(x, y) == 4


def test_median_and_scores_in_two_levels(spark):
    import statistics

    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0], [k * 0.37 % 1 for k in range(501)], [2.0] * 7):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert measures.median(df, "v").first().med == pytest.approx(statistics.median(values))
    assert measures.median(spark.createDataFrame([], "v double"), "v").first().med is None


def test_token_rows(spark):
    from quarrymill.operators import tokens as tk

    df = spark.createDataFrame([([1, 2, 3, 4, 5], [7, 8, 9])], "a array<int>, b array<int>")
    x, y = tk.fair_trim(F.col("a"), F.col("b"), 4)
    assert tuple(df.select(x, y).first()) == ([1, 2], [7, 8])
    x, y = tk.fair_trim(F.col("a"), F.array(F.lit(7)), 4)
    assert tuple(df.select(x, y).first()) == ([1, 2, 3], [7])
    assert df.select(tk.pattern_mask(F.col("a"), [[2, 3], [5, 6]])).first()[0] == [1, 0, 0, 1, 1]
    assert df.select(tk.truncate(F.col("a"), 3, 0, left=True), tk.truncate(F.col("a"), 3, 5)).first() == ([4, 5, 0], [1, 2, 5])
    w = df.select(tk.rolling_windows(F.col("a"), 3, 2, 0)).first()[0]
    assert [(r.start, r.inputs, r.targets) for r in w] == [(0, [0, 1, 2], [1, 2, 3]), (3, [2, 3, 4], [4, 5])]
    rows = spark.createDataFrame([(1, [1]), (2, [2, 3, 4]), (9, [5])], "k int, a array<int>").withColumn("m", tk.ones(F.col("a")))
    got = {r.k: (r.a, r.m) for r in tk.collate(rows, F.floor(F.col("k") / 8), {"a": 0, "m": 0}).collect()}
    assert got == {1: ([1, 0, 0], [1, 0, 0]), 2: ([2, 3, 4], [1, 1, 1]), 9: ([5], [1])}


def test_packing_equals_concatenation(spark):
    from quarrymill.operators import tokens as tk

    lists = [[k * 100 + j for j in range(n)] for k, n in enumerate([3, 1, 7, 12, 2, 5])]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, a array<int>")
    flat = [x for a in lists for x in [*a, -1]]
    for overlap in (0, 1):
        got = {r.seq: r.a for r in tk.pack(df, "k", {"a": -1}, 4, overlap=overlap).collect()}
        assert got == {s: flat[s * 4 : s * 4 + 4 + overlap] for s in range(len(flat)) if s * 4 + 4 + overlap <= len(flat)}
    assert tk.pack(df.limit(0), "k", {"a": -1}, 4).count() == 0


def test_parts_and_ranges(spark):
    assert ordering.proportions("8,1,1", 100) == [0, 80, 90, 100] and ordering.proportions("1/0/0", 7) == [0, 7, 7, 7]
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert {r.part: r["count"] for r in ordering.named_parts(df, "pos", {"a": 3, "b": -1}, 10).groupBy("part").count().collect()} == {"a": 3, "b": 7}
    with pytest.raises(ValueError):
        ordering.named_parts(df, "pos", {"a": 11}, 10)
    r = spark.createDataFrame([(0, 3, "x"), (3, 3, "none"), (3, 900, "y")], "lo long, hi long, f string")
    got = ordering.assign_ranges(spark.createDataFrame([(k,) for k in (0, 2, 3, 899, 900)], "p long"), "p", r, "lo", "hi", 64)
    assert sorted((x.p, x.f) for x in got.collect()) == [(0, "x"), (2, "x"), (3, "y"), (899, "y")]


def test_tasks_accumulators_and_shards(spark):
    from quarrymill.operators import scoring

    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 1, 1)], "g string, y int, p int")
    t = scoring.register("unit", scoring.Task({"ok": (F.col("y") == F.col("p")).cast("int")}, {"acc": F.avg("ok")}, ["g"]))
    assert {r.g: r.acc for r in t.score(df).collect()} == {"a": 0.5, "b": 1.0}
    with pytest.raises(ValueError):
        scoring.register("unit", t)
    acc = scoring.Accumulator({"right": (F.col("y") == F.col("p")).cast("int"), "n": F.lit(1)}, lambda right, n: right / n)
    acc.update(df)
    acc.update(df.limit(0))
    assert acc.compute() == pytest.approx(2 / 3)
    got = sequential.map_shards(df, 3, F.col("g"), lambda part: part.groupby("g", as_index=False).agg(n=("y", "size"))[["g", "n"]], "g string, n long").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1)]


def test_answers(spark):
    from quarrymill.operators import scoring, tokens as tk

    df = spark.createDataFrame([("The cat, a cat!", "cat sat")], "x string, y string")
    a, b = scoring.answer_words(F.col("x")), scoring.answer_words(F.col("y"))
    assert df.select(a, scoring.bag_f1(a, b)).first() == (["cat", "cat"], 0.5)
    assert df.select(scoring.rouge_l(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "xbd")))).first()[0] == pytest.approx(4 / 7)
    refs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "c"]), (2, ["z"])], "q int, w array<string>")
    assert {r.q: r.f1 for r in scoring.leave_one_out(refs, "q", "w").collect()} == {1: 0.5, 2: 1.0}
    m = spark.range(1).select(tk.math_answer(F.lit("\\left( \\tfrac12 \\right) \\text{ cm}")), tk.detokenized(F.lit("( a ) 1 @,@ 000 .")), tk.basename(F.lit("a/b.c.gz")), tk.clean_name(F.lit("x/a b.c"))).first()
    assert tuple(m) == ("(\\frac{1}{2})", "(a) 1,000.", "b.c.gz", "a_b")


def test_bleu(spark):
    df = spark.createDataFrame([("the lamp is in the yard", "the lamp is in the yard"), (None, "x")], "a string, b string")
    assert sequential.corpus_bleu(df, "a", "b").first().bleu == pytest.approx(100)


def test_cleaned_chunks(spark):
    df = spark.createDataFrame([("a" * 700 + "HIT" + "b" * 700, [[700, 703]]), ("short HIT", [[6, 9]]), ("clean", []), (None, None)], "t string, h array<array<int>>")
    got = [r[0] for r in df.select(sequential.decontaminated(F.col("t"), F.col("h"))).collect()]
    assert got == [["a" * 500, "b" * 500], [], ["clean"], None]


def test_bag_alignment(spark):
    df = spark.createDataFrame([(["red lamp", "old rug"], ["old rug", "red lamp"]), (["a b"], ["a c"]), ([], ["x"])], "p array<string>, g array<string>")
    assert [tuple(r[0]) for r in df.select(sequential.bag_scores(F.col("p"), F.col("g"))).collect()] == [(1.0, 100.0), (0.0, 50.0), (0.0, 0.0)]


def test_token_files(spark, tmp_path):
    for k in (0, 1):
        np.arange(16 * k, 16 * k + 16 + k, dtype=np.uint16).tofile(tmp_path / f"{k}.bin")
        (np.arange(16 * k, 16 * k + 16 + k) % 4).astype(np.uint8).tofile(tmp_path / f"{k}.mask")
    files, masks = [str(tmp_path / f"{k}.bin") for k in (0, 1)], [str(tmp_path / f"{k}.mask") for k in (0, 1)]
    rows = readers.read_tokens(spark, files, 4, blocks=3).orderBy("idx").collect()
    assert [r.input_ids for r in rows] == [list(range(4 * k, 4 * k + 4)) for k in range(8)] and [r.idx for r in rows] == [*range(8)]
    rows = readers.read_tokens(spark, files, 4, masks=masks, metadata=["a", "b"], keep=lambda x: x[0] != 4).orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 2, 3, 4, 5, 6, 7] and rows[-1].metadata == "b" and all(r.label_mask == [0, 1, 2, 3] for r in rows)
    np.zeros(3, np.uint8).tofile(tmp_path / "short.mask")
    with pytest.raises(ValueError):
        readers.read_tokens(spark, files, 4, masks=[masks[0], str(tmp_path / "short.mask")])


def test_token_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, [k, k + 1], [1, 2]) for k in range(20)], "pos long, ids array<int>, m array<int>")
    out = tmp_path / "out"
    made = sinks.write_tokens(df, str(out), "ids", "pos", mask="m")
    flat = np.concatenate([np.fromfile(f + ".bin", dtype=np.uint16) for f, *_ in made])
    assert flat.tolist() == [x for k in range(20) for x in (k, k + 1)] and sum(n for _, _, n in made) == 40
    assert np.concatenate([np.fromfile(f + ".mask.bin", dtype=np.uint8) for f, *_ in made]).tolist() == [1, 2] * 20
    rolled = sinks.write_tokens_rolling(df, str(tmp_path / "rolled"), "ids", "pos", 10)
    assert [n for _, _, n in rolled] == [10] * 4 and np.concatenate([np.fromfile(f + ".bin", dtype=np.uint16) for f, *_ in rolled]).tolist() == flat.tolist()
    with pytest.raises(Exception, match="outside"):
        sinks.write_tokens(spark.createDataFrame([(0, [70000])], "pos long, ids array<int>"), str(tmp_path / "bad"), "ids", "pos")


def test_line_sinks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}", "ab"[k % 2]) for k in range(30)], "k int, text string, source string")
    sinks.write_lines(df, str(tmp_path / "a"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_lines(df, str(tmp_path / "a"))
    sinks.write_lines(df, str(tmp_path / "a"), replace=True)
    assert spark.read.json(str(tmp_path / "a")).count() == 30
    sinks.write_lines_in_order(df.orderBy(F.desc("k")), str(tmp_path / "b"), "k", "none")
    import json

    read = [json.loads(x)["k"] for f in sorted((tmp_path / "b").glob("part-*")) for x in f.read_text().splitlines()]
    assert read == [*range(30)]
    sinks.write_shards(df, str(tmp_path / "c"), 4)
    assert len([*(tmp_path / "c").glob("*.parquet")]) == 4 and readers.read_any(spark, [str(tmp_path / "c"), str(tmp_path / "c")]).count() == 60
    sinks.write_by_source(df, str(tmp_path / "d"), "source")
    assert readers.read_folder_texts(spark, str(tmp_path / "d")).count() == 30
    bad = sinks.dead_letters(df, F.col("k") < 28, F.col("k"), "TOO_LARGE", F.col("text")).collect()
    assert sorted(tuple(r) for r in bad) == [(28, "TOO_LARGE", "t28"), (29, "TOO_LARGE", "t29")]
    assert sinks.write_summary(df, str(tmp_path / "s"), rows=F.count("*")).first().rows == 30


def test_sources(spark, tmp_path):
    import gzip

    with open(tmp_path / "x.jsonl.gz", "wb") as f:
        f.write(gzip.compress(b'{"text": "a"}\n') + gzip.compress(b'{"text": "b"}\n'))
    assert readers.read_compressed(spark, str(tmp_path / "x.jsonl.gz"), 3).count() == 2
    (tmp_path / "n.csv").write_text("1,2.5\n2,3.5\n")
    assert [r._c1 for r in readers.read_any(spark, str(tmp_path / "n.csv"), header=False).collect()] == [2.5, 3.5]
    assert readers.numbered_paths("s3://x/part-{}.json.gz", 8, 10, 3) == ["s3://x/part-008.json.gz", "s3://x/part-009.json.gz", "s3://x/part-010.json.gz"]
    made = readers.from_generator(spark, lambda part: ((part, k) for k in range(part)), "part int, k int", 4)
    assert sorted(map(tuple, made.collect())) == [(p, k) for p in range(4) for k in range(p)]
    df = spark.createDataFrame([(1, [*range(10)])], "idx int, t array<int>")
    assert readers.slice_of(df, "idx", 1, "t", 3, 4).first().t == [3, 4, 5, 6]


def test_read_any(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}')
    (tmp_path / "b.tsv").write_text("a\tb\n1\tx\n")
    assert readers.read_any(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert readers.read_any(spark, str(tmp_path / "b.tsv")).first().b == "x"


def test_statistics_of_arriving_files(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(k, k / 10) for k in range(10)], "id int, s double").repartition(3).write.parquet(src)
    stream = running.stream_of(spark, src, "id int, s double", 1)
    running.filter_statistics(stream, F.col("s") >= 0.5, str(tmp_path / "out"), str(tmp_path / "cp"))
    total = spark.read.parquet(str(tmp_path / "out" / "counts")).agg(F.sum("read"), F.sum("kept")).first()
    assert tuple(total) == (10, 5) and spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 5


def test_pairs_as_both_streams_arrive(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spark.createDataFrame([(1, at(0), "p"), (1, at(30), "q"), (2, at(1), "r")], "k int, t timestamp, x string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, at(2), "c"), (1, at(31), "d"), (2, at(40), "late"), (3, at(1), "none")], "k int, t timestamp, x string").write.parquet(str(tmp_path / "c"))
    sides = [running.stream_of(spark, str(tmp_path / n), "k int, t timestamp, x string") for n in "pc"]
    out = running.paired_stream(*sides, "k", "t", "24 hours")
    out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, r.parent_x, r.child_x) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [(1, "p", "c"), (1, "q", "d")]


def test_taggers(spark):
    from quarrymill.operators import tagging

    df = spark.createDataFrame([("You go\nnow",), (None,), ("",)], "t string")
    got = [r.second_person for r in tagging.tagged(df, "t", ["second_person"]).collect()]
    assert [tuple(x) for x in got[0]] == [(0, 6, 0.5), (7, 10, 0.0)] and got[1] is None and [tuple(x) for x in got[2]] == [(0, 0, 0.0)]
    model = tagging.of_model(lambda texts: [[(0, len(t), 0.25)] for t in texts])
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(model(F.col("t"))).collect()] == [[(0, 10, 0.25)], None, [(0, 0, 0.25)]]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from quarrymill.session import shared_dir

    fake = lambda master, found: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: found), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(fake("yarn", "hdfs://x/cp/")) == "hdfs://x/cp" and shared_dir(fake("local[2]", None)).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(fake(master, None))


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "quarrymill"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "quarrymill.llm" not in f.read_text(), f


def test_every_index_gets_a_chunk(spark):
    """Ids beyond the first ten ranges count too, and the SQL of the query says the same."""
    import duckdb

    from quarrymill.plans import registry, relations

    ids = [0, 999, 1000, 9999, 10_000, 25_500, 99_999]
    got = {tuple(r) for r in relations.j11_every(spark.createDataFrame([(k,) for k in [*ids, None]], "event_id bigint")).select("chunk", "n").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE TABLE events AS SELECT unnest({[*ids]})::BIGINT AS event_id")
    assert got == set(c.execute(registry.oracle_sql()["j11_every_index"]).fetchall()) == {(0, 2), (1, 1), (9, 1), (10, 1), (25, 1), (99, 1)}


def test_whole_prompts_are_tokenized(spark):
    from quarrymill.plans import arrays as plans

    prompt = "né😀" + "x" * 60
    got = plans.a19(spark.createDataFrame([(1, prompt), (2, None), (3, "")], "item_id int, prompt string")).collect()
    assert {r.item_id: r.ids for r in got} == {1: ",".join(str(ord(c)) for c in prompt), 3: ""}


def test_every_prompt_ngram_is_cut_out(spark):
    from quarrymill.plans import udfs

    prompt = "How do I Mend the old brass Lamp today"
    fill = "word " * 100
    rows = [(1, fill + prompt.upper() + " " + fill + fill + prompt + " " + fill), (1, "clean"), (2, (prompt + " ") * 5 + fill), (3, "library " * 3), (None, fill + prompt), (4, None)]
    got = udfs.a3_chunks(spark.createDataFrame([(7, prompt), (8, "too short"), (9, None)], "item_id int, prompt string"), spark.createDataFrame(rows, "doc_id int, text string")).collect()
    # 9 words are two 8-grams: document 1 has four hits, which leave three slices, document 2 at least ten, which leave none
    assert sorted((r.doc_id or 0, r.slices) for r in got) == [(0, 1), (1, 1), (1, 3), (2, 0), (3, 1)]


def test_word_spans(spark):
    x = "ab  c dé f"
    df = spark.createDataFrame([(x, [3, 0]), (x, None), (None, [0])], "t string, a array<int>")
    got = [r[0] for r in df.select(sequential.word_spans(F.col("t"), F.col("a"), 2)).collect()]
    assert [[x[a:b] for a, b in got[0]], got[1], got[2]] == [["ab ", "dé f"], [], []]
