"""Cost-balanced packing, ranked search and tokenizer alignment: against brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sorrel.llm import alignment, impact_index
from sorrel.llm import cost_packing as cp
from sorrel.llm.queries import byte_bpe, plain

SCHEMA = "doc_id long, text string"
ODD = [
    (1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (5, "  two\twords\r\n"), (6, "long one " * 9000), (7, "long one " * 9000), (None, "a b"), (8, "é😀 Größe ñ"), (9, "a▁b"),
    (10, "<|endoftext|> and <s> are plain"), (11, "don't   stop\x00here"), (12, "..., !?"), (13, "A_b-C"), (14, "x" * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows and, beside them, ordinary ones in several files; extra columns have names that operators use or return."""
    rng = random.Random(3)
    words = ["stone", "river", "light", "a", "of", "Größe", "don't", "x1", "ñandú"]
    more = [(100 + i, " ".join(rng.choices(words, weights=[1, 2, 3, 40, 40, 2, 2, 1, 1], k=rng.randint(1, 400)))) for i in range(300)]
    frame = spark.createDataFrame([*ODD, *more], SCHEMA).repartition(5)
    for name in ("start", "_row", "_block", "segment", "rank", "term", "Length", "_id"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def tokens_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = tokens_of.__dict__.setdefault("tok", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


# packing


@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([64, 48]))
@settings(max_examples=150, deadline=None)
def test_assignment_follows_its_rule(lengths, capacity):
    """Each whole piece is on the sequence of least cost with room, a cut one fills the largest room; all is placed."""
    lengths = [min(n, capacity) for n in lengths]
    cost = cp.Cost(1.0, 0.01)
    rooms = cp.capacities(sum(lengths), capacity)
    left, costs, seen, last = list(rooms), [0.0] * len(rooms), Counter(), capacity
    for item, start, n, s, offset in cp.assign(lengths, capacity, cost):
        whole = lengths[item] - start  # what was waiting of the item
        assert whole <= last and start == seen[item] and offset == rooms[s] - left[s]
        last = whole
        fits = [i for i, r in enumerate(left) if r >= whole]
        if fits:
            assert n == whole and costs[s] == min(costs[i] for i in fits)
        else:
            assert n == left[s] == max(left)
        left[s] -= n
        costs[s] += cost.of(n)
        seen[item] += n
    assert not any(left) and [seen[i] for i in range(len(lengths))] == lengths
    assert all(r == capacity or r & (r - 1) == 0 for r in rooms) and sum(rooms) == sum(lengths)


def check_packing(rows, texts, capacity):
    by_row = {}
    for doc_id, text in texts:
        by_row.setdefault(doc_id, []).append(np.array(tokens_of(text), "<u4"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == by_row.keys()
    for doc_id, own in by_row.items():
        got = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id])
        for ids in own:  # rows that repeat an id: each is covered by pieces of its own
            at = 0
            while at < len(ids):
                fit = next(k for k in got if got[k] and k[0] == at and k[3] == len(ids) and zlib.crc32(ids[at : at + k[1]].tobytes()) == k[2])
                got[fit] -= 1
                at += fit[1]
            assert at == len(ids)
        assert not +got
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total == capacity or total & (total - 1) == 0
    return sequences


@pytest.mark.parametrize("group", [cp.GROUP_PIECES, 40])
def test_packing(spark, docs, monkeypatch, group):
    monkeypatch.setattr(cp, "GROUP_PIECES", group)
    out = cp.balanced_packing(docs, byte_bpe(), capacity=256)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = out.collect()
    sequences = check_packing(rows, texts, 256)
    total = sum(len(tokens_of(t)) for _, t in texts)
    assert len(sequences) <= total // 256 + 8 * (1 if group > 1000 else len(rows) // 30)
    assert cp.balanced_packing(docs.where("false"), byte_bpe()).count() == 0
    kept = cp.balanced_packing(docs, byte_bpe(), capacity=256, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept) and len(kept) == len(rows)


def test_packing_balances_costs(spark):
    """Where no document fills a sequence alone, full sequences cost nearly the same; random places spread far wider."""
    rng = random.Random(5)
    lengths = [rng.choice([1, 2, 3, 60, 200, 500, 900]) for _ in range(4000)]
    cost, sums = cp.Cost(1.0, 1 / 1000), Counter()
    for _, _, n, s, _ in cp.assign(lengths, 2048, cost):
        sums[s] += cost.of(n)
    rooms = cp.capacities(sum(lengths), 2048)
    full = [sums[i] for i, r in enumerate(rooms) if r == 2048]
    spread = (max(full) - min(full)) / (sum(full) / len(full))
    dealt, held = Counter(), Counter()
    for n in rng.sample(lengths, len(lengths)):
        s = rng.choice([i for i in range(len(full) * 2) if held[i] + n <= 2048])
        held[s] += n
        dealt[s] += cost.of(n)
    assert spread < 0.25 < (max(dealt.values()) - min(dealt.values())) / (sum(dealt.values()) / len(dealt))


# search

TERM = re.compile(impact_index.TERM_PATTERN)


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    found = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    count, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms_of(text)}
        scored = []
        for (doc_id, c), n in zip(found, sizes, strict=True):
            m = 100 - 50 + (50 * n * count) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


@given(st.lists(st.lists(st.integers(0, 1 << 40), min_size=12, max_size=12), min_size=1, max_size=6), st.integers(1, 14))
@settings(max_examples=100, deadline=None)
def test_sums_and_tops_of_slices(columns, k):
    sliced = []
    for numbers in columns:
        bits, data = impact_index.sliced(np.array(numbers, np.int64))
        sliced.append(impact_index.opened(np.arange(12, dtype="<u2").tobytes(), bits, data, 12))
    total = []
    for s in sliced:
        total = impact_index.add(total, s)
    sums = [sum(c[i] for c in columns) for i in range(12)]
    places, scores = impact_index.top(total, k, lambda tied, n: np.sort(tied)[:n])
    want = sorted(((s, -i) for i, s in enumerate(sums) if s > 0), reverse=True)[:k]
    assert sorted(zip(scores, (-p for p in places), strict=True), reverse=True) == want


@pytest.mark.parametrize("segment", [impact_index.SEGMENT_DOCUMENTS, 200])
def test_ranked_search(spark, docs, monkeypatch, segment):
    monkeypatch.setattr(impact_index, "SEGMENT_DOCUMENTS", segment)
    items = [(1, "a stone of LIGHT"), (2, None), (3, ""), (4, "nowhere_to be"), (5, "Größe größe DON'T x1  "), (5, "two words"), (None, "river"), (7, "a"), (8, "long one é😀")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("doc_id", F.lit(2))
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = impact_index.ranked_search(docs, asked, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(map(tuple, got.collect()), key=lambda r: (str(r[0]), r[1]))
    assert rows == brute_search(texts, items, 20)
    assert any(a[3] == b[3] and a[0] == b[0] for a, b in zip(rows, rows[1:], strict=False))  # ties are among them
    assert impact_index.ranked_search(docs.where("false"), asked).count() == 0 == impact_index.ranked_search(docs, asked.where("false")).count()


def test_an_index_of_all_terms_and_blocks_of_items(spark, docs, monkeypatch):
    """An index of the whole vocabulary, long lists of terms and items taken in blocks change no result."""
    items = [(i, w) for i, w in enumerate(["a stone", "of", "ñandú x1", "river light", "words"])]
    asked = spark.createDataFrame(items, "item_id long, text string")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    of = impact_index.item_terms(asked)
    monkeypatch.setattr(impact_index, "BLOCK_ITEMS", 2)
    index = impact_index.ImpactIndex.build(docs)
    assert {r.term for r in index.slices.select("term").distinct().collect()} == {t for _, text in texts for t in terms_of(text)}
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[1]))
    assert order(index.search(of, 7).collect()) == brute_search(texts, items, 7)
    monkeypatch.setattr(impact_index, "SENT_TERMS", 1)
    assert order(impact_index.ranked_search(docs, asked, 7).collect()) == brute_search(texts, items, 7)


# alignment


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from sorrel.llm.tokenizer import _byte_of_char

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = _byte_of_char()
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        in_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        in_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(x) != (" " + text).encode() for x in (in_a, in_b)):
            docs.append(None)
            continue
        at = lambda parts: list(zip(np.cumsum([0, *map(len, parts)])[:-1], np.cumsum([len(p) for p in parts]), strict=True))
        spans_a, spans_b = at(in_a), at(in_b)
        linked, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            linked.append((i, j))
            end_a, end_b = spans_a[i][1], spans_b[j][1]
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = [",".join(str(x) for x, (_, e) in zip(a, spans_a, strict=True) if low < e <= cut) + "|" + ",".join(str(x) for x, (_, e) in zip(b, spans_b, strict=True) if low < e <= cut) for low, cut in zip([0, *cuts], cuts, strict=False)]
        docs.append((a, b, groups, [(a[x], b[y]) for x, y in linked]))
    count = Counter(p for d in docs if d for p in set(d[3]))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, linked = d
            out.append((len(a), len(b), len(groups), len(linked), sum(count[p] == best[p[0]] for p in linked), sum(count[p] for p in linked), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [alignment.BLOCK_DOCUMENTS, 130])
def test_alignment(spark, docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_DOCUMENTS", block)
    short = docs.where("text is null or length(text) < 5000")
    texts = [(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    out = alignment.align_tokenizers(short, plain("byte_bpe_50k.json"), plain("piece_bpe_32k.model"), keep_groups=True)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    rows = out.collect()
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, *r[1:8]) for r in rows) == order((d, *x) for (d, _), x in zip(texts, brute_alignment([t for _, t in texts]), strict=True))
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in rows)
    assert {r.doc_id: r.n_a for r in rows}[9] == 0  # its bytes do not come back
    assert alignment.align_tokenizers(docs.where("false"), plain("byte_bpe_50k.json"), plain("piece_bpe_32k.model")).count() == 0


def test_long_texts_align(spark):
    text = "stone Größe\t😀 " * 40_000
    (row,) = alignment.align_tokenizers(spark.createDataFrame([(1, text)], SCHEMA), plain("byte_bpe_50k.json"), plain("piece_bpe_32k.model")).collect()
    assert row.n_links >= row.n_a + row.n_b - row.n_groups > 0 and row.count_sum == row.n_links == row.n_best + (row.n_links - row.n_best)


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.data())
@settings(max_examples=100, deadline=None)
def test_links_of_any_two_cuts(a, data):
    total = sum(a)
    cuts = sorted(data.draw(st.sets(st.integers(1, total), max_size=20)) | {total})
    b = np.diff([0, *cuts])
    x, y, group_a, group_b = alignment.links(np.array(a), b)
    end_a, end_b = np.cumsum(a), np.cumsum(b)
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if end_a[i] - a[i] < end_b[j] and end_b[j] - b[j] < end_a[i]]
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == want
    both = sorted(set(end_a.tolist()) & set(end_b.tolist()))
    assert [sum(e > c for c in both) for e in end_a.tolist()] == group_a.tolist() and [sum(e > c for c in both) for e in end_b.tolist()] == group_b.tolist()


def test_other_vocabularies_have_no_bytes(spark):
    import public_tokenizers

    from sorrel.llm.tokenizer import TokenizerFile, token_bytes

    with pytest.raises(ValueError):
        token_bytes(TokenizerFile(public_tokenizers.path("word_bpe_49k.json")).ship(spark))
    ranks, same = (token_bytes(TokenizerFile(public_tokenizers.path(f"byte_bpe_50k.{k}")).ship(spark)) for k in ("tiktoken", "json"))
    assert ranks == same[:-1] and same[-1] == b""
