"""Encoding, residue, personal information and abuse on small texts with defined edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import abuse, encoding, pii, residue

VOCABULARY = f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeiou stnrl'  \n<|endoftext|>")), max_size=120))
def test_ids_equal_the_public_tokenizer(reference, text):
    assert encoding.encoder(VOCABULARY).encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_ids_of_edge_cases(spark, reference):
    long = "ab " * 50_000 + "a" * 5000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, long, "x"), (5, "<|endoftext|>", "x"), (5, "<|endoftext|>", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    rows = encoding.encode_texts(df, "doc_id", "text").collect()
    by = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 7 and by[1] == [] and by[2] == []
    assert by[4] == reference.encode(long, add_special_tokens=False).ids and by[5] == reference.encode("<|endoftext|>", add_special_tokens=False).ids
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0


RESIDUE = [
    "Lorem ipsum dolor sit amet consectetur elit", "Dear {{ name }}, your lamp is ready.", "404 Not Found\nThe requested URL /x/y was not found on this server.", "Title here\n\nPlease enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    "Erreur 500 : le serveur a rencontré un problème.", "Welcome to [INSERT CITY NAME HERE], home of the lamp.", "Only ${order.sum} for this lamp.", "NaN lamp in stock. undefined reviews for it.", "Hello %%NAME%%, we moved it.", "Your session for abc has expired. Please log in again.",
]
ORDINARY = [
    "Printers used lorem ipsum as filler long before we sold a lamp.", "How do I escape {{ name }} in the zz template engine?", "We all got a 404 on the library page, then someone fixed it.", "I turned JavaScript off and the forum feels faster.", "The internal server error in zz was caused by a draft.",
    "const a = (x, y) => `${x}-${y}`;", "In the config of zz you write ${HOME}/cache and it works.", "A function that returns undefined is a bug.", "For placeholders, zz uses [brackets] and fills them in.", "cp ${SRC}/a.txt /tmp/b", "It took 404 days to move the lamp.", "", "   ", None,
]


def test_residue(spark):
    rows = [(k, t, "x") for k, t in enumerate(RESIDUE)] + [(100 + k, t, "x") for k, t in enumerate(ORDINARY)] + [(0, RESIDUE[0], "x"), (None, RESIDUE[0], "x"), (500, "A plain line. " * 20000 + RESIDUE[3], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, template string")
    got = [r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()]
    assert sorted(got) == [*range(len(RESIDUE)), 500]
    assert residue.residue_documents(df.limit(0), "doc_id", "text").count() == 0


def test_templates_widen_where_messages_differ():
    leaf = residue.Leaf()
    t = [residue.tokens(f"Error 404: page {x} of the shop does not exist.") for x in ("ab", "cd", "ef")]
    assert len({residue.leaf_of(x) for x in t}) == 1
    assert {leaf.add(x, 1, 0.5) for x in t} == {0} and "<*>" in leaf.templates[0] and leaf.documents == [3]
    assert residue.leaf_of(residue.tokens("Please enable cookies now")) != residue.leaf_of(residue.tokens("Please enable lamps now"))


HELD_OUT = ["Welcome to our docs, {{name}}!", "Hello {first_name}, your order is on its way.", "Dear Mr <<LASTNAME>>, thank you.", "Insert headline here", "Please switch JavaScript on in your browser settings.", "410 Gone", "Página no encontrada", "Pagina non trovata", "Sayfa bulunamadı", "La pagina richiesta non esiste."]


def test_residue_of_other_wordings(spark):
    rows = [(k, t) for k, t in enumerate(HELD_OUT)] + [(50, "I had to switch JavaScript on in my browser."), (51, "The page was gone when we came back."), (52, "In this engine {{name}} is a placeholder.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()) == [*range(len(HELD_OUT))]


def test_weak_wording_needs_evidence(spark):
    notice = "The document that you asked the lovely little archive for today at the front desk in the hall is not available"
    other = "Some more lines of plain text follow it here and there in a long letter. " * 6
    df = lambda n: spark.createDataFrame([(k, f"{notice}\n{other}{k}") for k in range(n)], "doc_id bigint, text string")
    assert residue.residue_documents(df(2), "doc_id", "text").count() == 0
    assert residue.classify(" ".join(residue.tokens(notice)), 1, 0.1) is None
    assert residue.classify(" ".join(residue.tokens(notice)), 5, 0.9) == "error"


def test_ordinary_messages_hide_no_residue(spark):
    """Messages that differ from residue in the deciding word stay out of its template, whichever comes first."""
    pairs = [("Please enable JavaScript to continue.", "Please enable cookies to continue."), ("Page not found.", "Page not loading."), ("404 Not Found", "404 Not Allowed"), ("JavaScript is disabled.", "JavaScript is fun."), ("Internal server error", "Internal server room")]
    want = {2 * k for k in range(5)} | {1}
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id bigint, text string").coalesce(1)
        assert {r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()} == want


def test_mentions(spark):
    text = "Please write to jane.doe@website.com or call +44 7911 123456. Signed by Robert Wilson.\nThey live at 12 Orchard Road and her SSN 978-06-6481 was on it. 😀 Ask for Mrs. Johnson today."
    kinds = {"email": "jane.doe", "phone": "+44", "name": "Robert", "address": "12 Orchard", "id_number": "978-06"}
    rows = [("a", text), ("a", text), ("n", None), ("e", ""), (None, text), ("plain", "Nobody paid 41 dollars for the lamp. The order number is 1041-2221-83, and it was checked."), ("long", "plain words follow here. " * 4000 + text)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "id string, text string, start_pos int")
    got = [(r.doc_key, r.pii_type, r.start_pos) for r in pii.mentions(df, "id", "text").collect()]
    assert len(got) == len(set(got))
    for key, lead in (("a", 0), ("long", 24 * 4000 + 4000)):
        want = {(key, k, lead + text.index(v)) for k, v in kinds.items()} | {(key, "name", lead + text.index("Johnson"))}
        missed = {(key, "name", lead + text.index("Robert"))}  # see test_name_before_a_line_end
        assert want - missed == {g for g in got if g[0] == key} - missed
    assert not [g for g in got if g[0] == "plain"]
    red = {r.doc_key: r.redacted for r in pii.redact(df, "id", "text").collect()}
    assert red["n"] is None and red["e"] == "" and red["a"].startswith("Please write to [EMAIL] or call [PHONE].") and "😀" in red["a"]
    assert pii.mentions(df.limit(0), "id", "text").count() == 0


@pytest.mark.xfail(reason="the shipped weights miss a name that a full stop and a line end follow", strict=False)
def test_name_before_a_line_end():
    text = "Signed by Robert Wilson.\nThey live at 12 Orchard Road and her lamp was on."
    assert [(text[s:e], pii.KINDS[k]) for s, e, k in pii.find_mentions([text], pii.tagger())[0]][0] == ("Robert Wilson", "name")


@pytest.mark.parametrize("text", ["When Zbigniew Kowalski called", "And Zbigniew Kowalski said", "ZBIGNIEW KOWALSKI was here", "then zbigniew kowalski called us", "yesterday Zbigniew Kowalski called, we left."])
def test_names_after_any_word_and_in_any_case(text):
    ((s, e, kind),) = pii.find_mentions([text], pii.tagger())[0]
    assert pii.KINDS[kind] == "name" and text[s:e].lower() == "zbigniew kowalski"


def test_whole_texts_are_covered_by_windows():
    for n in (1, pii.WINDOW, pii.WINDOW + 1, 5 * pii.WINDOW):
        w = pii.windows_of(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b[0] < a[1] for a, b in zip(w, w[1:])) and all(b - a <= pii.WINDOW for a, b in w)


def generated(seed, n):
    from quarrymill.llm import pii_train

    r = random.Random(seed)
    p = pii_train.Prose(r, VOCABULARY)
    return [pii_train.made(r, p) for _ in range(n)]


def test_stretches_lose_nothing():
    """Decoding only the stretches gives the labels of the full recursion."""
    m = pii.tagger()
    assert m.w["move"][0, 2] == pii.NEVER
    texts = [t[:150] for t, _ in generated(3, 40)]
    n = np.array([len(t) for t in texts])
    x = np.full((150, len(texts)), pii.PAD, np.int16)
    for j, t in enumerate(texts):
        x[: len(t), j] = pii.codes(t)
    e, move = m.emissions(x), m.w["move"]
    got = np.zeros((150, len(texts)), int)
    pieces = m.pieces(x, n)
    for (j, first, _, _), y in zip(pieces, m.decode([p[1:] for p in pieces])):
        got[first : first + len(y), j] = y
    for j in range(len(texts)):
        score, back = e[:, 0, j] + m.w["start"], []
        for t in range(1, n[j]):
            s = score[:, None] + move
            back.append(s.argmax(0))
            score = s.max(0) + e[:, t, j]
        y = [int(score.argmax())]
        for b in back[::-1]:
            y.append(int(b[y[-1]]))
        assert got[: n[j], j].tolist() == y[::-1]


@pytest.mark.parametrize("before, name, after", [("I think ", "Ursula Hammergren", " left early."), ("It was late.\n--\n", "Petra Dahlmeister", "\nnurse at the clinic"), ("Do you know ", "Thomas Wexmoor", " from the choir?"), ("That coat is owned by ", "Victoria Stamwick", ".\n\nNobody saw it."), ("The keys of ", "Pierre Lamotte", " were found.")])
def test_names_without_a_cue_and_at_line_ends(before, name, after):
    (found,) = pii.find_mentions([before + name + after], pii.tagger())
    assert found == [(len(before), len(before) + len(name), pii.KINDS.index("name"))]


def test_scores_of_a_window_do_not_depend_on_those_beside_it():
    m, texts = pii.tagger(), ["It belongs to Daniel Quillmark.", "The nurse and the tailor argued over a green lamp, and nobody saw it.", "ok"]
    wide = np.full((80, 3), pii.PAD, np.int16)
    for j, t in enumerate(texts):
        wide[: len(t), j] = pii.codes(t)
    every = m.emissions(wide)
    for j, t in enumerate(texts):
        np.testing.assert_allclose(m.emissions(pii.codes(t)[:, None])[:, :, 0], every[:, : len(t), j], atol=1e-3)


def test_copies_of_a_text_are_searched_once(monkeypatch):
    m, seen = pii.Tagger(), []
    pieces = m.pieces
    monkeypatch.setattr(m, "pieces", lambda x, n: seen.extend(n.tolist()) or pieces(x, n))
    text = "Do you know Thomas Wexmoor from the choir?"
    found = pii.find_mentions([text, "", text, "It was late.", text], m)
    assert sorted(seen) == [12, len(text)]
    assert found[0] == found[2] == found[4] == [(12, 26, pii.KINDS.index("name"))] and found[1] == found[3] == []


def test_stretches_of_windows_of_different_lengths_lose_nothing():
    """On random scores, up to the last character of windows beside longer ones."""
    m, r = pii.tagger(), np.random.default_rng(7)
    move, every = m.w["move"], 0
    for _ in range(40):
        e = np.repeat(r.normal(0, 3, (pii.LABELS, 8, 6)), 6, axis=1).astype(np.float32)
        e[0] += np.float32(r.choice([0, 3, 5]))
        n = r.integers(1, 49, 6)
        n[2] = 48
        found = m.stretches(e, n)
        every += sum(end - first for _, first, end in found)
        got = np.zeros((48, 6), int)
        for (j, first, end), y in zip(found, m.decode([(first, end == n[j], e[:, first:end, j]) for j, first, end in found])):
            got[first:end, j] = y
        for j in range(6):
            score, back = e[:, 0, j] + m.w["start"], []
            for t in range(1, n[j]):
                s = score[:, None] + move
                back.append(s.argmax(0))
                score = s.max(0) + e[:, t, j]
            y = [int(score.argmax())]
            for b in back[::-1]:
                y.append(int(b[y[-1]]))
            assert got[: n[j], j].tolist() == y[::-1]
    assert every < 40 * 6 * 48


def test_held_out_accuracy_of_mentions():
    made = generated(99, 500)
    found = pii.find_mentions([t for t, _ in made], pii.tagger())
    want = {(k, a, kind) for k, (_, s) in enumerate(made) for a, _, kind in s}
    got = {(k, a, kind) for k, f in enumerate(found) for a, _, kind in f}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)


def test_training_step_lowers_the_loss():
    from quarrymill.llm import pii_train

    r = random.Random(1)
    t = pii_train.Trainer()
    x = pii_train.batch(r, pii_train.Prose(r, VOCABULARY), 16)
    first = t.step(*x, rate=0.02)
    for _ in range(8):
        last = t.step(*x, rate=0.02)
    assert last < first


BAD = ["you are a {a} {b} and your lamp proves it", "get a life {b} and leave it alone", "what a {a} {b} you turned out to be", "shut your mouth you {a} {b}"]
GOOD = ["the nurse and the tailor argued over a {c} lamp", "i tested a {c} coat at the library", "damn this soup is so {c}", "the {c} terminal shows the survey", "my {c} lamp arrived today"]


def sentences(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        bad = r.random() < 0.4
        s = r.choice(BAD if bad else GOOD).format(a=r.choice(["stupid", "useless", "filthy"]), b=r.choice(["idiot", "moron", "loser", "jackass"]), c=r.choice(["green", "dumb", "good", "old"]))
        out.append((s, bad))
    return out


def test_abuse_machine_on_held_out_and_disguised():
    train = sentences(1, 600)
    m = abuse.train([s.split() for s, _ in train], np.array([int(b) if i % 12 else 1 - int(b) for i, (_, b) in enumerate(train)]), landmarks=120)
    test = sentences(2, 300)
    right = (m.scores([s for s, _ in test]) > 0) == np.array([b for _, b in test])
    assert right.mean() > 0.97
    for word in ("m0r0n", "m-o-r-o-n", "l*s*r", "mooooron", "id10t", "lоsеr", "mor​on"):
        assert m.scores([f"Get a life {word} and leave it alone."])[0] > 0, word
    assert m.scores([None, "", " . "]).tolist() == [-1, -1, -1]


def test_inserted_and_spaced_letters():
    train = sentences(1, 600)
    m = abuse.train([s.split() for s, _ in train], np.array([int(b) for _, b in train]), landmarks=120)
    r = random.Random(3)
    words = [w for w in m.lexicon if len(w) > 3 and w in ("stupid", "useless", "filthy", "idiot", "moron", "loser", "jackass")]
    assert len(words) >= 6
    for w in words:
        k = r.randint(1, len(w) - 1)
        assert m.uncover(w[:k] + r.choice("xqz") + w[k:]) == w
    assert m.uncover("lamps") == "lamps"
    assert abuse.sentences("you m o r o n go") == [["you", "moron", "go"]] and abuse.sentences("a b or i u") == [["a", "b", "or", "i", "u"]]


def test_pair_weights_are_a_dictionary():
    keys = np.unique(np.random.default_rng(1).integers(0, 10**9, 5000))
    table = abuse.PairWeights(keys, np.arange(len(keys), dtype=np.float32))
    assert (table.of(keys) == np.arange(len(keys))).all() and not table.of(keys + 10**9 + 1).any()


def test_subsequence_kernel():
    assert abuse.subsequence_kernel("ab", "ab", 2, 0.5) == pytest.approx(0.5**4)
    assert abuse.subsequence_kernel("axb", "ab", 2, 0.5) == pytest.approx(0.5**5)
    assert abuse.likeness("loser", "loser") == pytest.approx(1)


def test_abuse_frames(spark):
    good, bad = "The old lamp is in the yard today.", "You are a stupid idiot and a loser."
    rows = [(f"g{k}", good, "s", [[0.0, float(len(good)), 0.01]]) for k in range(30)] + [(f"b{k}", bad, "s", [[0.0, float(len(bad)), 0.99]]) for k in range(30)]
    rows += [("n", None, None, None), ("e", "", "t", []), (None, bad, "s", None), ("b0", bad, "s", [[0.0, float(len(bad)), 0.99]]), ("o", good, "s", [[0.0, 9e9, 0.99], None, [1.0]])]
    df = spark.createDataFrame(rows, "id string, text string, source string, toxic_spans array<array<double>>")
    got = [r.id for r in abuse.abusive_records(df).collect()]
    assert sorted(got) == sorted(f"b{k}" for k in range(30))
    rates = {r.source: (r.records, r.abusive) for r in abuse.abuse_rates(df).collect()}
    assert rates == {"s": (61, 30), "t": (1, 0), None: (1, 0)}
    assert abuse.abusive_records(df.limit(0)).count() == 0
