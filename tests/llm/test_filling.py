"""Packing and mixing: every token placed once, capacities and shares kept."""

import random

import pytest

from quarrymill.llm import mixing, packing


def lower_bound(sizes, capacity):
    return -(-sum(sizes) // capacity)


def best_fit_decreasing(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= s
        else:
            free.append(capacity - s)
    return len(free)


def test_plan_places_all_and_is_near_the_bound():
    r = random.Random(2)
    for top in (20, 120, 400):
        sizes = [r.randint(1, top) for _ in range(600)]
        counts = {s: sizes.count(s) for s in set(sizes)}
        plan = packing.plan_bins(counts, 400).bins
        placed = {}
        for times, b in plan:
            assert sum(b) <= 400
            for s in b:
                placed[s] = placed.get(s, 0) + times
        assert placed == counts
        if top < 400:
            assert sum(t for t, _ in plan) <= lower_bound(sizes, 400) + 1


def fewest(sizes, capacity):
    """The least number of bins by trying every bin for every item."""
    best = best_fit_decreasing(sizes, capacity)
    sizes = sorted(sizes, reverse=True)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for f in {f for f in free if f >= sizes[k]}:
            j = free.index(f)
            free[j] -= sizes[k]
            place(k + 1, free)
            free[j] += sizes[k]
        place(k + 1, [*free, capacity - sizes[k]])

    place(0, [])
    return best


def test_plans_are_optimal_on_small_cases():
    r = random.Random(5)
    for k in range(400):
        low, high = ((1, 100), (18, 60), (20, 50))[k % 3]
        sizes = [r.randint(low, high) for _ in range(r.randint(3, 10))]
        plan = packing.plan_bins({s: sizes.count(s) for s in sizes}, 100)
        assert plan.proven and plan.count == sum(t for t, _ in plan.bins) == fewest(sizes, 100), sizes


def test_plans_of_short_items_and_none():
    plan = packing.plan_bins({3: 1, 2: 3000})
    assert plan.proven and plan.count == 3 and sum(t * len(b) for t, b in plan.bins) == 3001
    assert packing.plan_bins({}).count == 0


def test_dominated_fillings_are_left_out():
    left = {60: 1, 30: 1, 25: 1, 15: 1, 10: 1}
    found = packing.undominated(40, [10, 15, 25, 30, 60], left, 40, [1000])
    assert [30, 10] in found and [25, 15] in found and [25, 10] not in found and [30] not in found


def test_sequences_hold_every_token_once(spark):
    r = random.Random(1)
    ids = [(k, [k * 10000 + j for j in range(n)]) for k, n in enumerate([0, 1, 50, 50, 50, 64, 65, 200, 128, 13] + [r.randint(1, 64) for _ in range(120)])]
    ids += [ids[3], (900, None), (None, [1, 2])]
    masks = [(k, [x % 4 for x in a]) for k, a in ids if a and k not in (None, 5, 6)] + [(6, None), (7, [3])]
    masks = [m for m in masks if m[0] != 7 or len(m[1]) == 1]
    i = spark.createDataFrame([(k, a, 1) for k, a in ids], "item_id bigint, input_ids array<int>, mask int")
    m = spark.createDataFrame(masks, "item_id bigint, label_mask array<int>")
    rows = packing.packed_sequences(i, m, 64).collect()
    real = {k: a for k, a in ids if k is not None and a}
    flat = [t for x in rows for t in x.input_ids]
    assert sorted(flat) == sorted(t for a in real.values() for t in a)
    assert all(len(x.input_ids) == len(x.label_mask) == x.used <= 64 for x in rows)
    code = {t: c for x in rows for t, c in zip(x.input_ids, x.label_mask)}
    given = {k: v for k, v in masks if v}
    for k, a in real.items():
        g = given.get(k, [])
        assert [code[t] for t in a] == (g + [1] * len(a))[: len(a)]
    for x in rows:  # only items over the capacity are split
        for k in set(x["items"]):
            if len(real[k]) <= 64:
                assert set(real[k]) <= set(x.input_ids)
    report = packing.packing_report(i, 64).first()
    rests = [len(a) % 64 for a in real.values() if len(a) % 64]
    assert report.bins == len(rows) <= best_fit_decreasing(rests, 64) + sum(len(a) // 64 for a in real.values())
    assert packing.packed_sequences(i.limit(0), m, 64).count() == 0


def test_rake_meets_marginals():
    import numpy as np

    tokens = np.array([10.0, 20, 30, 40])
    w = mixing.rake(tokens, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([60.0, 40]), np.array([50.0, 50])])
    assert w[:2].sum() == pytest.approx(60) and w[::2].sum() == pytest.approx(50)


def test_mix_keeps_shares_and_repeats(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["river", "lamp", "soup", "of", "the"]) for _ in range(r.randint(5, 60))), r.choice(["en", "EN", "de", None]), r.choice(["Web", "web ", "chat", "misc", None])) for k in range(1500)]
    rows += [rows[0], (5000, None, "en", "web"), (5001, "", "en", "web"), (None, "x y", "en", "web")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, lang string, source string, tokens int")
    targets = spark.createDataFrame([("web", 0.5, 1), ("chat", 0.4, 3), ("gone", 0.1, 2)], "source string, weight double, max_repeats int")
    got = mixing.mixed_documents(docs, targets).collect()
    assert len({x.doc_id for x in got}) == len(got)
    most = {"web": 1, "chat": 3}
    assert all(1 <= x.copies <= most[x.source] for x in got)
    share = {x.source: x.share for x in mixing.mix_report(docs, targets).collect()}
    assert share["gone"] == 0 and share["web"] == pytest.approx(5 / 9, abs=0.01) and share["chat"] == pytest.approx(4 / 9, abs=0.01)
    assert mixing.mixed_documents(docs.limit(0), targets).count() == 0
    assert mixing.mixed_documents(docs, targets.limit(0)).count() == 0


def test_capped_raking_keeps_all_margins_it_can():
    import numpy as np

    tokens = np.array([100.0, 300.0, 50.0, 500.0, 200.0, 80.0])
    axes = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])]
    targets = [np.array([200.0, 200.0, 100.0]), np.array([250.0, 250.0])]
    want = mixing.rake_capped(tokens, axes, targets, tokens * 4)
    for a, t in zip(axes, targets):
        assert np.allclose(np.bincount(a, weights=want), t, rtol=1e-4)
    most = np.array([60.0, 300.0, 400.0, 500.0, 200.0, 80.0])
    want = mixing.rake_capped(tokens, axes, targets, most)
    assert (want <= most * (1 + 1e-9)).all() and np.allclose(np.bincount(axes[0], weights=want), targets[0], rtol=1e-6)
    assert np.allclose(np.bincount(axes[1], weights=want), targets[1], rtol=1e-3)
