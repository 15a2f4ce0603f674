"""Near duplicates, overlaps across splits and leaks against brute force, with nulls, copies, ties and empty tables."""

import itertools
import random

import numpy as np

from quarrymill.llm import leaks, near_duplicates, split_overlap
from quarrymill.llm.words import split_words

WORDS = [f"w{k}" for k in range(300)]


def texts(seed: int, n: int = 60):
    """Texts in families: copies, edits, reorderings, and unrelated ones."""
    r = random.Random(seed)
    out = []
    for _ in range(n // 5):
        base = [r.choice(WORDS) for _ in range(r.randint(42, 90))]
        out.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(r.randint(0, 16)):
                t[r.randrange(len(t))] = r.choice(WORDS)
            if r.random() < 0.4:
                k = r.randrange(len(t))
                t = t[k:] + t[:k]
            out.append(t)
        out.append([r.choice(WORDS) for _ in range(r.randint(3, 60))])
    return [" ".join(t) for t in out]


def runs(t):
    w = split_words(t)
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 40 else set()


def alike(a, b):
    x, y = runs(a), runs(b)
    return bool(x and y) and 2 * len(x & y) >= len(x | y)


def test_near_duplicates_find_every_pair(spark):
    rows = [(f"k{i:03d}", t, "x", 1) for i, t in enumerate(texts(1))]
    rows += [("k000", rows[0][1], "x", 2), ("copy", rows[0][1].upper() + "!!", None, 3), ("null", None, "x", 4), (None, rows[1][1], "x", 5), ("empty", "", "x", 6), ("long", "zz yy xx " * 20000, "x", 7)]
    df = spark.createDataFrame(rows, "id string, text string, digest string, s int")
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", "text").collect()}
    one = {i: t for i, t, *_ in rows if i and t}
    want = {(a, b) for a, b in itertools.combinations(sorted(one), 2) if alike(one[a], one[b])}
    assert want and got == want
    report = near_duplicates.near_duplicate_report(df, "id", "text").collect()
    assert len({r.id for r in report}) == len(report)
    assert {r.id: r.class_id for r in report}["copy"] == {r.id: r.class_id for r in report}["k000"]


def whole_groups(pairs):
    """The smallest member of each node's component, by union-find."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in list(up)}


def test_groups_join_edited_records(spark):
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts(1))] + [("copy", texts(1)[0].upper() + "!!")]
    df = spark.createDataFrame(rows, "id string, text string")
    report = {r.id: r for r in near_duplicates.near_duplicate_report(df, "id", "text").collect()}
    want = whole_groups((a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if alike(x, y))
    assert any(report[x].class_id != report[g].class_id for x, g in want.items())
    assert {x: r.group_id for x, r in report.items()} == {x: want.get(x, x) for x in report}


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    names = [f"n{k:02d}" for k in range(60)]
    r.shuffle(names)
    links = list(zip(names[:24], names[1:25])) + [(names[25], x) for x in names[26:36]] + [tuple(r.sample(names[36:], 2)) for _ in range(16)]
    links = [tuple(sorted(x)) for x in links]
    got = near_duplicates.components(spark.createDataFrame(links, "a string, b string")).collect()
    want = whole_groups(links)
    assert sorted((x.class_id, x.group_id) for x in got) == sorted((x, g) for x, g in want.items() if x != g)


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert near_duplicates.near_duplicate_pairs(df, "id", "text").count() == 0


def test_split_files_lose_nothing(monkeypatch):
    """Keys that are split into square blocks still bring every pair together."""
    import pyarrow as pa

    n = 40
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{k}" for k in range(n)]), pa.array([5] * n, pa.int32()), pa.array([b"\0" * (near_duplicates.PLANES // 8)] * n, pa.binary()), pa.array([[7]] * n, pa.list_(pa.int32())), pa.array([[4]] * n, pa.list_(pa.int8()))], names=["id", "n", "sketch", "keys", "heavy"])
    rows = [r for b in near_duplicates._filed([batch], 3) for r in b.to_pylist()]
    files = {}
    for r in rows:
        for k in r["keys"]:
            files.setdefault(k, set()).add(r["id"])
    met = {p for f in files.values() for p in itertools.combinations(sorted(f), 2)}
    assert met == set(itertools.combinations(sorted(f"r{k}" for k in range(n)), 2))
    assert max(len(f) for f in files.values()) < n


def test_a_round_sends_few_copies_of_a_class():
    """What one round shuffles stays in proportion to the classes, however many parts a large table has."""
    import pyarrow as pa

    n, files = 500, 56
    for classes in (190_000, 2_000_000, 12_700_000, 130_000_000):
        parts, rounds = near_duplicates.parts_and_rounds(classes, classes * files)
        assert rounds <= files / near_duplicates.COPIES + 1
        assert classes * min(1, files / parts) * near_duplicates.CLASS_BYTES <= 1.1 * near_duplicates.PART_BYTES
    parts, rounds = near_duplicates.parts_and_rounds(12_700_000, 12_700_000 * files)
    keys = np.random.default_rng(5).integers(0, 1 << 31, (n, files)).astype(np.int32)
    two = [near_duplicates.to_blobs(x, np.full(n, files * 4)) for x in (keys, np.ones_like(keys))]
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{k}" for k in range(n)]), pa.array([112] * n, pa.int32()), pa.array([b"\0" * (near_duplicates.PLANES // 8)] * n, pa.binary()), *two], names=["id", "n", "sketch", "keys", "heavy"])
    sent, filed = [], 0
    for k in range(rounds):
        rows = [r for b in near_duplicates._sent([batch], parts, parts * k // rounds, parts * (k + 1) // rounds) for r in b.to_pylist()]
        heads = [np.frombuffer(r["heads"], np.int32).reshape(-1, 3) for r in rows]
        sent.append(sum(len(h) for h in heads) / n)
        filed += sum(int(h[:, 2].sum()) for h in heads)
    assert max(sent) <= 1.25 * near_duplicates.COPIES and filed == n * files


def test_pairs_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES", 1)
    rows = [(f"k{i:03d}é", t) for i, t in enumerate(texts(2))]
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string").repartition(3), "id", "text").collect()}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(rows), 2) if alike(x, y)}
    assert want and got == want


def test_sliced_distances_are_exact():
    r = np.random.default_rng(3)
    n, planes = 150, near_duplicates.PLANES
    bits = (r.random((n, planes)) < 0.5).astype(np.uint8)
    bits[1::3] = bits[::3]
    flip = r.random((n, planes)) < 0.06
    bits ^= flip.astype(np.uint8)
    sizes = r.integers(60, 240, n)
    sketch = np.packbits(bits, axis=1, bitorder="little")
    got = {tuple(p) for p in near_duplicates.sliced_pairs(np.zeros(n, np.int64), np.arange(n), sizes, sketch, 1, 3).tolist()}
    want = {(a, b) for a, b in itertools.combinations(range(n), 2) if 3 * int((bits[a] != bits[b]).sum()) <= sizes[a] + sizes[b]}
    assert want and got == want


def test_overlaps_of_long_records(spark):
    a, b = texts(2), texts(2)
    random.Random(5).shuffle(b)
    e = spark.createDataFrame([(f"e{k}", t) for k, t in enumerate(a)] + [("e0", a[0]), ("n", None), (None, a[0])], "key string, text string")
    t = spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(b)], "key string, text string")
    got = [(r.eval_key, r.train_key) for r in split_overlap.overlapping_records(e, t, split_overlap.LONG, split_overlap.same_runs, 40).collect()]
    want = {(f"e{i}", f"t{j}") for i, x in enumerate(a) for j, y in enumerate(b) if alike(x, y)}
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.95 * len(want)


def test_overlaps_of_short_records(spark):
    r = random.Random(8)
    base = [" ".join(r.choice(WORDS) for _ in range(22)) for _ in range(40)]
    edited = []
    for x in base:
        w = x.split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(22)] = "new"
        edited.append(" ".join(w).upper() + " !")
    e = spark.createDataFrame(list(enumerate(edited)), "key bigint, text string")
    t = spark.createDataFrame(list(enumerate(base)), "key bigint, text string")
    got = {(x.eval_key, x.train_key) for x in split_overlap.overlapping_records(e, t, split_overlap.SHORT, split_overlap.few_edits).collect()}
    assert got == {(str(k), str(k)) for k in range(40)}
    none = spark.createDataFrame([], "key bigint, text string")
    assert split_overlap.overlapping_records(none, t, split_overlap.SHORT, split_overlap.few_edits).count() == 0


def test_report_counts_each_source(spark):
    words = " ".join(WORDS[:50])
    u = spark.createDataFrame([("a", words, "forum", "test"), ("b", " ".join(WORDS[100:160]), None, "valid"), ("a", words, "forum", "test")], "id string, text string, source string, split string")
    n = spark.createDataFrame([("x", words), ("y", None)], "id string, text string")
    p = spark.createDataFrame([(1, "you silly old goat over there", "s", "train"), (2, "You silly old goat, over there!", "s", "test")], "pair_id bigint, en_toxic_comment string, source string, split string")
    rows = {(r.dataset, r.split, r.source): (r.records, r.overlapping, r.pairs) for r in split_overlap.overlap_report(u, n, p).collect()}
    assert rows == {("unseen_data", "test", "forum"): (1, 1, 1), ("unseen_data", "valid", None): (1, 0, 0), ("paradetox", "test", "s"): (1, 1, 1)}


def brute_leak(doc, item):
    d, w = split_words(doc), split_words(item)
    best = 0
    for shift in range(-len(w), len(d) + 1):
        eq = [0 <= k + shift < len(d) and d[k + shift] == w[k] for k in range(len(w))]
        for i in range(len(w)):
            bad = 0
            for j in range(i, len(w)):
                bad += not eq[j]
                if bad > 2:
                    break
                best = max(best, sum(eq[i : j + 1]))
    return bool(w) and best >= -(-len(w) // 2)


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(n))) for k, n in enumerate([1, 3, 5, 9, 14, 23, 40, 60])]
    docs = []
    for k in range(80):
        _, t = r.choice(items)
        w = t.split()
        a, b = sorted((r.randint(0, len(w)), r.randint(0, len(w))))
        part = w[a:b] if r.random() < 0.7 else w[len(w) // 2 :] + w[: len(w) // 2]
        for _ in range(r.randint(0, 3)):
            if part:
                part[r.randrange(len(part))] = "other"
        docs.append((str(k), " ".join([r.choice(WORDS) for _ in range(9)] + ["\n> "] + part + [r.choice(WORDS) for _ in range(9)]).title()))
    docs += [("0", docs[0][1]), ("null", None), ("empty", ""), (None, docs[1][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "id string, text string, item_id int")
    it = spark.createDataFrame(items + [(0, items[0][1]), (99, None), (98, " ... ")], "item_id bigint, prompt string")
    rows = leaks.leaked_items(df, "id", "text", it, "item_id", "prompt").collect()
    got = [(x.doc_key, x.item_id) for x in rows if x.stretch >= x.need]
    want = {(a, i) for a, b in docs if a and b for i, t in items if len(t.split()) >= 8 and brute_leak(b, t)}
    assert len(got) == len(set(got)) and {g for g in got if g[1] > 2} == want
    assert all(x.stretch >= x.need or x.coverage >= leaks.COVERAGE for x in rows)
    assert leaks.leaked_items(df.limit(0), "id", "text", it, "item_id", "prompt").count() == 0
    assert leaks.leaked_items(df, "id", "text", it.limit(0), "item_id", "prompt").count() == 0


def test_reordered_passages_leak_by_coverage(spark):
    w = [f"w{k}" for k in range(24)]
    docs = [("thirds", " ".join(w[16:] + w[8:16] + w[:8])), ("edited", " ".join(w[:6] + ["x"] + w[6:12] + w[13:])), ("opening", " ".join(w[:7] + ["y"] * 30))]
    df = spark.createDataFrame(docs, "id string, text string")
    it = spark.createDataFrame([(1, " ".join(w)), (2, "the dog"), (3, " ".join(w))], "item_id bigint, prompt string")
    rows = {(x.doc_key, x.item_id): (x.coverage, x.stretch, x.need) for x in leaks.leaked_items(df, "id", "text", it, "item_id", "prompt").collect()}
    assert set(rows) == {(d, i) for d in ("thirds", "edited") for i in (1, 3)}
    assert rows["thirds", 1] == (1.0, 8, 12) and rows["edited", 1][0] > 0.9


def test_hot_seeds_lose_no_leak(spark):
    """Items with a common opening: its seeds leave the index, and a document with an item's own half still leaks."""
    opening = [f"o{k}" for k in range(10)]
    own = {i: [f"i{i}x{k}" for k in range(12)] for i in range(40)}
    it = spark.createDataFrame([(i, " ".join(opening + own[i])) for i in own], "item_id bigint, prompt string")
    docs = [(str(i), " ".join(opening[3:] + own[i][:6])) for i in own] + [("none", " ".join(opening))]
    rows = leaks.leaked_items(spark.createDataFrame(docs, "id string, text string"), "id", "text", it, "item_id", "prompt").where("stretch >= need").collect()
    assert sorted((int(x.doc_key), x.item_id) for x in rows) == [(i, i) for i in own]


def test_bit_planes_transpose():
    r = np.random.default_rng(2)
    sketch = r.integers(0, 256, (50, 12), dtype=np.uint8)
    rec = r.integers(0, 50, 8192 + 77)
    planes = near_duplicates.bit_planes(sketch, rec, 8192 // 64 + 4)
    lanes = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")[:, : len(rec)]
    assert (lanes == np.unpackbits(sketch[rec], axis=1, bitorder="little").T).all()


def test_parts_have_partitions_of_their_own(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 30):
        df = spark.createDataFrame([(int(k),) for k in near_duplicates.even_keys(n)], "part int")
        assert sorted(r[0] for r in df.repartition(n, "part").select(F.spark_partition_id()).collect()) == [*range(n)]


def test_tiles_cover_reordered_passages():
    item = np.arange(20)
    doc = np.r_[item[10:], 99, item[:10]]
    found = leaks.tiles(doc, item, np.array([0, 11]), np.array([10, 0]))
    assert sum(n for *_, n in found) == 20
