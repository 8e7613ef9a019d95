"""Toxicity, near duplicates, mixing, packing, search, preferences and the pipeline."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sorrel.llm import hamming, minhash, mixing, packing, packing_plan, preferences, queries, toxicity
from sorrel.llm.common import materialize
from sorrel.llm.shingles import chunks, shingle_sets

SCHEMA = "doc_id long, text string"
DIR = "/root/testdata/sf0.001"


def prose(rng, n, stems=("an", "er", "on", "ing", "th", "re", "ly", "st")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(2, 4))) for _ in range(n))


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_item_once(histogram):
    slots, n, bound = packing_plan.plan(histogram, 64)
    ranks, fill = Counter(), {}
    for s in slots:
        for i in range(s.times * s.copies):
            ranks[s.length, s.first + i] += 1
            fill.setdefault(s.sequence + i % s.times, []).append((s.offset + i // s.times * s.length, s.length))
    assert ranks == Counter({(k, i): 1 for k, v in histogram.items() for i in range(v)})
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    plain = sum(times for times, _ in packing_plan.fill_rest(histogram, 64))
    assert len(fill) == n and bound - 1e-6 <= n <= 1.1 * plain + 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 20), min_size=1, max_size=12), st.integers(30, 64))
@settings(max_examples=60, deadline=None)
def test_rest_is_first_fit_decreasing_by_counts(histogram, capacity):
    placed = Counter()
    for times, config in packing_plan.fill_rest(histogram, capacity):
        assert times > 0 and sum(n * c for n, c in config.items()) <= capacity
        placed.update({n: times * c for n, c in config.items()})
    assert placed == Counter(histogram)


def test_plan_stays_small_at_any_count():
    rng = random.Random(12)
    histogram = {n: rng.randint(1, 40) for n in range(3, 1500)}
    sizes = []
    for times in (1, 100, 10_000):
        counts = {k: v * times for k, v in histogram.items()}
        slots, n, bound = packing_plan.plan(counts, 2048)
        widths, rows = packing._places(slots, counts)
        assert n <= 1.002 * bound + 1 and len(rows) <= 3 * len(slots)
        sizes.append(len(slots))
    assert max(sizes) < 2 * sizes[0] < packing.BROADCAST_ROWS


def test_packing_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(80)] + [(100, None), (101, ""), (102, "word " * 900), (103, "w " * 40), (104, "w " * 40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("clash")).withColumn("offset", F.lit(0))
    got = packing.pack_documents(docs, queries.byte_bpe(), capacity=128, keep_ids=True).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts, fill = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, {})[r.piece] = np.frombuffer(r.ids, "<u4").tolist()
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        assert [x for k in sorted(parts[i]) for x in parts[i][k]] == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(len(p) == 128 for k, p in parts[i].items() if k)
    assert all(sum(n for _, n in v) <= 128 for v in fill.values())
    assert packing.pack_documents(docs.where("false"), queries.byte_bpe()).count() == 0


def test_shingles_do_not_depend_on_neighbours():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 40)] + ["a a a a a a a a", "é b, c! d e f", "x" * 3_000_000]

    def of(column):
        out = {}
        for a, b, data, offsets in chunks(column):
            t, e, w = shingle_sets(data, offsets)
            for i in range(b - a):
                out[a + i] = (e[t == i].tolist(), w[t == i].tolist())
        return out

    together = of(pa.array(texts))
    for i, t in enumerate(texts):
        assert together[i] == of(pa.array([t]))[0]
    assert together[0] == ([], []) and len(together[1][0]) == 1 and together[6][1] == [4]


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = np.arange(1, 120, dtype=np.uint64), np.arange(30, 150, dtype=np.uint64)
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    m = 4000
    sig = [minhash.signatures(np.zeros(len(x), int), x, w.astype(float), 1, m)[0][0] for x, w in ((a, wa), (b, wb))]
    want = minhash.probability_jaccard(a, wa, b, wb)
    A, B = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    slow = sum(1 / sum(max(A.get(y, 0) / A[x], B.get(y, 0) / B[x]) for y in {*A, *B}) for x in A.keys() & B.keys())
    assert abs(want - slow) < 1e-9 and abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [prose(rng, 120).split() for _ in range(12)]
    rows, want = [], {}
    for i, words in enumerate(base):
        for k in range(4):  # one of 120 words differs from the original
            w = list(words)
            if k:
                w[rng.randrange(120)] = f"new{k}"
            rows.append((10 * i + k, " ".join(w)))
            want[10 * i + k] = 10 * i
        rows.append((10 * i + 5, " ".join(words).upper()))
        want[10 * i + 5] = 10 * i
        rows.append((10 * i + 7, " ".join(words[:60]) + " " + prose(rng, 60)))
        want[10 * i + 7] = 10 * i + 7
    odd = [(1001, None), (1002, ""), (1003, "one two"), (1004, "One, two!"), (1005, "..."), (None, "one two")]
    want |= {1001: 1001, 1002: 1001, 1003: 1003, 1004: 1003, 1005: 1005}
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumn("class_id", F.lit("clash"))
    got = minhash.near_duplicates(docs.drop("class_id").withColumn("kept", F.lit(1))).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want and len(got) == len(rows) + len(odd)
    several = {c for i, c in want.items() if c < 1000 and i != c}
    assert all((r.links > 0) == (r.class_id in several) for r in got if r.doc_id is not None and r.doc_id < 1000)
    stay = minhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {*want.values(), None}
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_large_bucket_keeps_links(spark):
    """Copies of one text that each differ from it but hardly from 0.8 among themselves all join through it."""
    rng = random.Random(6)
    words = prose(rng, 60).split()
    rows = [(500, " ".join(words))]
    for i in range(150):
        w = list(words)
        w[(7 * i) % 60] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in got} == {500}


def plain_classes(rows, size=5, least=0.8):
    """The smallest id of each id's component, from all pairs and plain Jaccard similarity."""
    sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("block", [minhash.BLOCK, 40])
def test_template_families_keep_links(spark, monkeypatch, block):
    """One long passage in all texts puts them into large buckets; pairs share little more than it, but enough."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(10)
    template, rows = [f"t{k}" for k in range(104)], []
    for i in range(70):
        for k in range(2):
            rows.append((2 * i + k, " ".join([*template, *(f"s{i}x{j}" for j in range(3)), *(f"o{i}y{k}z{j}" for j in range(11))])))
    # a component as large as a block, whose members differ in the template's first words
    for i in range(90):
        rows.append((1000 + i, " ".join([f"c{i}", *template[1:], *(f"u{j}" for j in range(30))])))
    rng.shuffle(rows)
    want = plain_classes(rows)
    assert len(set(want.values())) == 71
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == want


@pytest.mark.parametrize("family", [1, 90])
def test_repeated_passages_keep_links(spark, family):
    """A passage repeated many times leaves the sets of shingles alike, but not the weighted ones."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(20):
        words = [f"w{i}x{k}" for k in range(300)]
        rows += [(1000 * i, " ".join(words)), (1000 * i + 1, " ".join(words + words[50:60] * 100))]
        want |= {1000 * i: 1000 * i, 1000 * i + 1: 1000 * i}
    for k in range(2, family):  # a large bucket
        rows.append((k, " ".join([*(f"w0x{j}" for j in range(300)), *[f"y{k}", "a", "b", "c", "d", "e", "f"] * rng.randint(1, 40)])))
        want[k] = 0
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5)]
    got = minhash.components(materialize(spark.createDataFrame(links, "_a long, _b long"), "l"))
    assert {r._id: r._root for r in got.collect()} == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 4)}


INSULTS = ("grobfax", "snidwurt", "plonkery")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(700):
        text, bad = prose(rng, 40), i % 5 == 0
        if bad:
            w = text.split()
            w[rng.randrange(40)] = rng.choice(INSULTS)
            w[rng.randrange(40)] = rng.choice(INSULTS)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(10_000, None), (10_001, ""), (10_002, "..."), (None, "an er on")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == 704
    held = [i for i in range(700) if got[i].held_out]
    assert 150 < len(held) < 320
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert not got[10_000].predicted and not got[10_001].predicted
    say = lambda t: model.score(toxicity.Scorer(model)([t]))[0]
    clean = say("an er on there")
    assert say("you g r o b f a x snidwurt") > 0.7 > clean and say("you snid-wurt plonkery") > 0.7 and say("gro-bfaxx plonkkery") > clean
    stay = toxicity.drop_toxic(docs, model)
    assert stay.columns == docs.columns and stay.where("doc_id is null").count() == 1
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(docs, None).where("score <> 0").count() == 0 and toxicity.score(docs.where("false"), model).count() == 0


def test_held_out_labels_are_not_read(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a.weights == b.weights).all() and (a.calibration == b.calibration).all()


def test_kernel_normalises_and_windows():
    row, dim, value = toxicity.features(["^abc$", "^abcabc$", "^a$", "ab"])
    assert np.allclose(np.bincount(row, value**2, minlength=4)[:3], 1) and not (row == 3).any()
    assert len(toxicity.windows("x" * 200)) > 8 and toxicity.tokens("a i d i o t b") >= {"aidiotb"}


def random_model(seed):
    rng = np.random.default_rng(seed)
    return toxicity.Model(rng.normal(size=toxicity.DIMENSIONS).astype(np.float32), -0.9, np.ones(7))


def plain_decision(model, word):
    """The largest of a word's windows, by the general features."""
    spelt = toxicity.windows(word)
    row, dim, value = toxicity.features(spelt)
    return max(np.bincount(row, value * model.weights[dim], minlength=len(spelt))) + model.bias


def test_decisions_are_those_of_the_features():
    model, rng = random_model(1), random.Random(2)
    words = ["", "a", "aa", "aaa", "x" * 32, "x" * 33, "ab" * 40, "\u00df" * 35, "\U0001f600x\U0001f600", *("".join(rng.choices("abcde\u00e9", k=rng.randint(0, 70))) for _ in range(300))]
    got = model.decisions(words)
    assert np.allclose(got, [plain_decision(model, w) for w in words], rtol=0, atol=1e-12)
    for n in (1, 2, 3, 7):  # the same in any company
        assert (got == np.concatenate([model.decisions(words[i : i + n]) for i in range(0, len(words), n)])).all()
    assert not len(model.decisions([]))


@given(st.text("ab\u00e9 .,-_\n\x1c\u3000I1", max_size=40))
@settings(max_examples=300, deadline=None)
def test_letters_that_stand_apart_are_joined(text):
    low = text.lower()
    assert toxicity.tokens(text) == set(low.split()) | {toxicity._INNER.sub("", m[0]) for m in toxicity._SPACED.finditer(low)}


@pytest.mark.parametrize("keep", [5, 60, 10_000])
def test_evidence_and_witnesses_are_those_of_all_words(keep):
    model, rng = random_model(3), random.Random(4)
    texts = [" ".join(rng.choice(["an", "er", "on", "w,", "(x)", "f u c k", "snid-wurt", "--", "?"]) + rng.choice(["", "er", ".", "on,", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    scorer = toxicity.Scorer(model)
    scorer.KEEP = keep
    word = lambda t: max([plain_decision(model, f) for f in toxicity.forms(t)], default=model.bias)
    for at in range(0, 60, 7):
        some = texts[at : at + 7]
        for row, found, text in zip(scorer(some), scorer.witnesses(some), some, strict=True):
            bag = toxicity.tokens(text)
            each = [word(t) for t in bag]
            top = sorted([*each, *[model.bias] * (4 - len(each))], reverse=True)[:4]
            assert np.allclose(row, [1, *top, np.log1p(max(len(bag), 16)), *(np.log1p(sum(d > c for d in each)) for c in toxicity.COUNTED)])
            sentences = [b for b in map(toxicity.tokens, toxicity._SENTENCE.split(text)) if b]
            assert found.keys() <= bag | set().union(*sentences)
            assert np.allclose(sorted(found.values()), sorted({w: word(w) for w in found}.values()))
            assert all(any(np.isclose(d, max(map(word, b))) for d in found.values()) for b in sentences)


def test_a_spelling_is_decided_once(monkeypatch):
    decided, own = [], toxicity.Model.decisions
    monkeypatch.setattr(toxicity.Model, "decisions", lambda self, words: decided.extend(words) or own(self, words))
    scorer = toxicity.Scorer(random_model(5))
    for text in ("one two, (three) two", "one. Two! three four-five", "two? fourfive; five. FOUR"):
        scorer([text])
        list(scorer.witnesses([text]))
    assert sorted(decided) == sorted(set(decided)) == ["five", "four", "fourfive", "one", "three", "two"]
    scorer.KEEP = 8  # what goes from the words that are known is looked up among those that were known before
    scorer(["six seven one"])
    scorer(["one two eight"])
    assert sorted(decided) == sorted(set(decided))


def test_a_process_keeps_its_words_between_tasks():
    model = random_model(6)
    assert toxicity.Scorer.of(model) is toxicity.Scorer.of(model) is not toxicity.Scorer.of(random_model(6))


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 50, ("an", "er", "on")) if i % 4 else prose(rng, 50, ("zu", "ko", "qi"))) for i in range(400)] + [(1000, None), (1001, ""), (None, "an er")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    tok = queries.byte_bpe()
    got = mixing.mixing_rates(docs, labels, tok, {"0": 0.4, "1": 0.6}).collect()
    p, t, r = np.array([x.posteriors for x in got]), np.array([x.n_tokens for x in got]), np.array([x.rate for x in got])
    total = (p * (t * r)[:, None]).sum(0)
    assert len(got) == 403 and np.allclose(total / total.sum(), [0.4, 0.6], atol=1e-4) and r.min() > 0.99
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in got)
    small = mixing.mixing_rates(docs, labels, tok, {"0": 0.999, "1": 0.001}, total=float(0.3 * t.sum())).collect()
    r = np.array([x.rate for x in small])
    assert r.min() >= 0 and r.mean() < 0.9
    out = mixing.mixed_documents(docs, labels, tok, {"0": 0.4, "1": 0.6})
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in got)
    assert {x.rate for x in mixing.mixing_rates(docs, labels.where("false"), tok).collect()} == {1.0}
    assert mixing.mixing_rates(docs.where("false"), labels, tok).count() == 0


def test_rates_can_be_held_at_one(spark):
    rows = [(10, [0.9, 0.1])] * 10 + [(10, [0.1, 0.9])] * 10
    members = materialize(spark.createDataFrame(rows, "_tokens long, _p array<double>"), "m")
    targets = np.array([900.0, 100.0])
    assert min(r._rate for r in mixing.fit_rates(members, targets).collect()) < 0.5
    held = sorted(r._rate for r in mixing.fit_rates(members, targets, least_rate=1.0).collect())
    assert held[0] == 1.0 and 9 < held[-1] < 11


def brute_top(codes, q, k):
    far = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes.items() if i != q)
    return [(i, d) for d, i in far[:k]]


@pytest.mark.parametrize("group", [8, 4096])
def test_hamming_search(spark, group):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(5)]
    codes = {i: centres[i % 5] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for i in range(300)} | {i: rng.getrandbits(64) for i in range(300, 400)} | dict.fromkeys(range(400, 430), centres[0])
    signed = [(i, c - 2**64 if c >= 2**63 else c) for i, c in codes.items()]
    df = materialize(spark.createDataFrame(signed, "_id long, _code long"), "c")
    got = {}
    for r in hamming.search_top_k(df.where("_id % 20 = 0"), df, 10, group).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    assert got == {q: brute_top(codes, q, 10) for q in codes if q % 20 == 0}


def test_vectors_on_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (20, [1.0, -1.0]), (20, [1.0, -1.0]), (1, None), (None, [1.0, 1.0]), (2, [None, 1.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.neighbor_id, r.distance) for r in hamming.nearest_codes(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0), (0, 2, 3, 1), (0, 3, 2, 2), (20, 1, 0, 0), (20, 2, 3, 1), (20, 3, 2, 2)]
    assert hamming.nearest_codes(df.where("false")).count() == 0


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (0, 0, "user", "hi"), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, None, None), (7, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.pair_id: r for r in preferences.preference_pairs(df).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].chosen == "<|assistant|>\nyes<|end|>\n" and got[0].prompt_turns == 1
    assert got[0].rejected == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n"
    assert got[0].chosen_loss == "0:25" and got[0].rejected_loss == "0:24"
    assert got[1].chosen == got[1].rejected == got[1].chosen_loss == "" and got[3].prompt == "<||>\n<|end|>\n"
    assert preferences.preference_segments(df.where("false")).count() == 0 and preferences.preference_pairs(df.where("false")).count() == 0


def test_long_preferences_keep_all_turns(spark):
    """Two conversations of 3000 turns with a common prefix of 2000, against plain loops."""
    say = lambda conv, turn: f"{turn}" * 3 if turn < 2000 or conv == 0 else f"other {turn}"
    rows = [(conv, turn, ("user", "assistant")[turn % 2], say(conv, turn)) for conv in (0, 1) for turn in range(3000)]
    (got,) = preferences.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    shown = lambda conv, turns: [f"<|{('user', 'assistant')[t % 2]}|>\n{say(conv, t)}<|end|>\n" for t in turns]
    assert got.prompt == "".join(shown(0, range(2000))) and got.prompt_turns == 2000
    for conv, text, loss in ((0, got.chosen, got.chosen_loss), (1, got.rejected, got.rejected_loss)):
        want = shown(conv, range(2000, 3000))
        assert text == "".join(want)
        assert [text[slice(*map(int, x.split(":")))] for x in loss.split(",")] == want[1::2]


def test_oracle_pairs_have_prefixes(spark):
    got = queries.op10_preferences(spark, DIR).collect()
    assert got and all(r.prompt_turns > 0 and r.chosen_loss for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), c.execute(queries.ORACLES[name]).df()
    rows = lambda df: sorted(map(repr, (tuple(None if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, stages = docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_duplicates", "near_duplicates", "mixing", "packing"]
    for name in list(stages)[:-1]:
        before, seen = seen, materialize(stages[name](spark, seen, DIR), name)
        assert seen.columns == docs.columns
        a, b = {r.doc_id for r in before.collect()}, {r.doc_id for r in seen.collect()}
        assert b <= a
        if name == "exact_duplicates":
            assert seen.select("text").distinct().count() == seen.count() == before.select("text").distinct().count()
        if name == "near_duplicates":
            assert minhash.near_duplicates(seen).where("not kept").count() == 0
        if name == "mixing":
            assert a == b
    out = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()}
