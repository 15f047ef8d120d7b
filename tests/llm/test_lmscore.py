import math
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import lmscore
from seqloom.llm.common import crc_mod


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    langs = [[a + b for a in "bdfg" for b in ("a", "i")], [a + b for a in "klmn" for b in ("o", "u")]]
    out = []
    for i in range(n):
        s = langs[i % 2]
        out.append((i, " ".join("".join(rnd.choice(s) for _ in range(rnd.randrange(1, 4))).upper() for _ in range(rnd.randrange(5, 60))), "x"))
    # texts that occur twice, and one that shares a passage
    out += [(2000 + k, out[k][1], "x") for k in (10, 11, 12, 13)]
    return [*out, (1000, None, "x"), (1001, "", "x"), (1002, " a\x0b\x0c b\xa0c ", "x"), (1003, "é" * 3000, "x"), (None, "ba da", "x"), (5, "ba", "x"), (5, "ba", "x")]


def words_of(t):
    return [*(t or "").encode().lower().split(), lmscore.END]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_base(rs):
    c = Counter(w for i, t, _ in rs if not is_held(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), is_held(i), len(words_of(t)), sum(c[w] > 0 for w in words_of(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words_of(t)), 6)) for i, t, _ in rs)


def frame(spark, rs):
    return spark.createDataFrame(rs, "doc_id long, text string, score string").coalesce(1)


def scored(spark, rs):
    return lmscore.score(frame(spark, rs), crc_mod(F.col("doc_id"), 7) == 2).toPandas()


def contexts(word, place, state, before):
    """The four contexts of a byte of a word: exact, in place of their hashes. before: two letters and a space."""
    seen = {0: before, 1: before[1:] + word[:1]}.get(place, b" " + word[:place])
    last = lambda k: seen[max(0, len(seen) - k) :]
    return (state, word[:place]), (state, last(2)), last(3), last(5)


def spelled_slowly(words, states, coder):
    """Byte by byte: (word, contexts, node, side, place, last byte) of every decision."""
    for i, (w, state) in enumerate(zip(words, states)):
        before = (b" " + words[i - 1])[-2:] + b" " if i else b"\n\n\n"
        spelled = w if w == lmscore.END else w + b" "
        for place, byte in enumerate(spelled):
            c = contexts(spelled, place, state, before)
            for j in range(coder.length[byte]):
                yield i, c, int(coder.node[byte, j]), int(coder.side[byte, j]), min(place, 2), (before + spelled)[2 + place]


def test_base_and_score_against_a_slow_model(spark, monkeypatch):
    # tables so wide that contexts hardly ever share a slot: the slow model has none that do
    monkeypatch.setattr(lmscore, "LEAST_BITS", 23)
    monkeypatch.setattr(lmscore, "TABLE_BITS", (23,) * 4)
    rs = rows()
    p = scored(spark, rs)
    got = sorted((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in p.itertuples())
    assert got == brute_base(rs)
    h = p[p.held_out & (p.doc_id < 300)]
    # better than counting words by far: all words are made of few syllables
    assert h.score.sum() / h.n_tokens.sum() > h.base_score.sum() / h.n_tokens.sum() + 0.2

    train = [t for i, t, _ in rs if not is_held(i)]
    model, _ = lmscore.fitted(frame(spark, rs).filter(~F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))).select(F.col("text").alias("_text")))
    states = {t: model.coder.topics.states(lmscore.Batch([t], None)).tolist() for _, t, _ in rs}
    # counts by exact context
    seen = defaultdict(lambda: [0, 0])
    for t in train:
        for _, c, node, side, _, _ in spelled_slowly(words_of(t), states[t], model.coder):
            for k in range(4):
                seen[k, c[k], node][side] += 1
    # known stretches, each text's own left out
    def cut(words):
        b = lmscore.Batch([b" ".join(words[:-1]).decode()], None)
        return [(tuple(words[s - 2 : s]), tuple(words[s:e]), s, e) for s, e in zip(*lmscore.stretches(b)[:2])]

    every, whole = Counter(), Counter()
    for t in train:
        for a, s, *_ in cut(words_of(t)):
            every[a] += 1
            whole[a, s] += 1
    # all stand in one slab and one block: the odds of classes are those without any other block
    odds = lmscore.known_odds(*(np.array(x, float) for x in zip(*[(0, 0 if k else sum(every.values())) for k in range(lmscore.CLASSES)])))
    _, kind = lmscore._typical()
    # but for the one of 12,000 contexts, of which one in a hundred shares a slot even so
    for i, t, _ in [r for r in rs if r[0] not in (None, 5, 1003)][::17] + [r for r in rs if r[0] in (1000, 1001, 1002, 2000, 10)]:
        words = words_of(t)
        cost = [0.0] * len(words)
        for w, c, node, side, place, last in spelled_slowly(words, states[t], model.coder):
            h = [int(lmscore.history(*(np.array([x]) for x in seen[k, c[k], node]))[0]) for k in range(4)]
            gate = 3 * (int(kind[h[0]]) if h[0] else 16 + (int(kind[h[3]]) & 7)) + place
            x = sum(model.weights[gate, k] * model.told[k, h[k]] for k in range(4)) + 0.3 * model.weights[gate, 4]
            # the middle of a step
            x = (min(int((max(-12, min(12, x)) + 12) * lmscore.FINE), 24 * lmscore.FINE - 1) + 0.5) / lmscore.FINE - 12
            mixed = 1 / (1 + math.exp(-x))
            at = min(max(2 * x + lmscore.BUCKETS // 2, 0), lmscore.BUCKETS - 1.001)
            low = int(at)
            refined = model.map[last, low] * (1 - at + low) + model.map[last, low + 1] * (at - low)
            q = min(max(0.5 * mixed + 0.5 * refined, 1e-5), 1 - 1e-5)
            cost[w] += math.log10(q if side else 1 - q)
        want = sum(cost)
        own_every, own_whole = Counter(a for a, *_ in cut(words)), Counter((a, s) for a, s, *_ in cut(words))
        tried = []
        for a, s, b, e in cut(words):
            n = every[a] - (0 if is_held(i) else own_every[a])
            c = whole[a, s] - (0 if is_held(i) else own_whole[a, s])
            if n:
                last = tried[-lmscore.LOOK_BACK :]
                x = odds[lmscore.seen_class(np.array([n]))[0]] + (math.log((sum(last) + 0.5) / (len(last) - sum(last) + 0.5)) if last else 0)
                q = min(max(1 / (1 + math.exp(-x)), 1e-5), 1 - 1e-5)
                spelling = sum(cost[b:e])
                want += math.log10(q * c / n + (1 - q) * 10**spelling) - spelling
                tried.append(c > 0)
        got = float(p[p.doc_id == i].score.iloc[0])
        assert math.isclose(got, want, rel_tol=0.01, abs_tol=0.02), (i, got, want)


def test_stretches_against_a_slow_model():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 90))) for _ in range(40)]
    texts += texts[:5]
    b = lmscore.Batch(texts, None)
    begin, end, context, own = lmscore.stretches(b)
    token = [b.words[i] for i in b.token]
    by_context, by_own = defaultdict(set), defaultdict(set)
    for x, y, c, h in zip(begin, end, context, own):
        by_context[int(c)].add(tuple(token[x - 2 : x]))
        by_own[int(h)].add(tuple(token[x:y]))
    # equal hashes stand for equal words only, and the other way round
    assert all(len(v) == 1 for v in by_context.values()) and all(len(v) == 1 for v in by_own.values())
    assert len(by_own) == len({t for v in by_own.values() for t in v})
    text = np.searchsorted(b.start, begin, "right") - 1
    _, record = np.unique(context * np.uint64(3) ^ own, return_inverse=True)
    _, group = np.unique(context, return_inverse=True)
    cost = np.array([-2.0 * (y - x) for x, y in zip(begin, end)], np.float32)
    train = np.arange(len(texts)) % 3 > 0
    c, every = np.bincount(record, train[text]).astype(int)[record], np.bincount(group, train[text]).astype(int)[group]
    per_record, per_group = np.zeros(record.max() + 1, np.int64), np.zeros(group.max() + 1, np.int64)
    per_record[record], per_group[group] = c, every
    odds = lmscore.known_odds(np.arange(lmscore.CLASSES) * 3.0, np.full(lmscore.CLASSES, 100.0))
    of_group = np.zeros(len(per_record), np.int64)
    of_group[record] = every
    got = lmscore.gains(odds, train, text, record, group, cost, per_record, of_group)
    tried = defaultdict(list)
    for i in range(len(begin)):
        mine = [j for j in range(len(begin)) if text[j] == text[i]] if train[text[i]] else []
        n = every[i] - sum(group[j] == group[i] for j in mine)
        k = c[i] - sum(record[j] == record[i] for j in mine)
        want = 0.0
        if n:
            last = tried[text[i]][-lmscore.LOOK_BACK :]
            x = odds[lmscore.seen_class(np.array([n]))[0]] + (math.log((sum(last) + 0.5) / (len(last) - sum(last) + 0.5)) if last else 0)
            q = 1 / (1 + math.exp(-x))
            want = math.log10(q * k / n + (1 - q) * 10 ** float(cost[i])) - float(cost[i])
            tried[text[i]].append(k > 0)
        assert math.isclose(got[i], want, rel_tol=1e-6, abs_tol=1e-6)


def test_order_of_words_and_copies_count(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [[rnd.choice(words) for _ in range(200)] for _ in range(60)]
    held = [i for i in range(2000) if is_held(i)]
    train = [i for i in range(2000) if not is_held(i)]
    rs = [(i, " ".join(t), "x") for i, t in zip(train, texts)]
    shuffled = texts[7][:]
    rnd.shuffle(shuffled)
    rs += [(held[0], " ".join(texts[7]), "x"), (held[1], " ".join(shuffled), "x"), (train[100], " ".join(texts[8]), "x")]
    p = scored(spark, rs).set_index("doc_id").score
    # a copy of a training text, its words in another order, and a training text that occurs twice
    assert p[held[0]] > 0.6 * p[held[1]]
    assert p[train[8]] > 0.6 * p[train[9]]


def test_decisions_make_a_distribution(spark):
    """The probabilities of all bytes that may begin a word sum to one."""
    texts = ["a b a", "b a", "a a a b", "c\x01 b"] * 20
    train = spark.createDataFrame([(t,) for t in texts], "_text string")
    model, _ = lmscore.fitted(train)
    # every byte as the first one after "ab ", of the second kind
    n = lambda x: np.full(256, x, np.uint64)
    one = lmscore.Batch([], model.coder.topics)
    one.previous, one.head, one.kind = n((33 << 18 | ord("b") + 1 << 9 | ord("a") + 1) << 18), n(lmscore._mult[20]), n(1)
    one.place, one.byte = np.zeros(256, np.int64), np.arange(256).astype(np.uint8)
    assert math.isclose((10 ** model.edge_scores(one)).sum(), 1, rel_tol=1e-3)


def test_prefix_code_is_complete():
    length, node, side = lmscore.prefix_code(np.arange(256))
    assert math.isclose(sum(2.0 ** -int(n) for n in length), 1)


def test_empty_and_untrained(spark):
    assert len(scored(spark, [])) == 0
    held = [i for i in range(50) if is_held(i)]
    p = scored(spark, [(i, "a b", "x") for i in held])
    assert (p.train_tokens == 0).all() and (p.n_known == 0).all() and (p.base_score == 0).all() and np.isfinite(p.score).all()


def test_words_of_slices():
    texts = ["a  b\tC", None, "", " x\x0by ", "é\xa0z", "longer text with words"] * 5
    for at in (0, 3, 7):
        one = lmscore.Batch(pa.array(texts).slice(at), None)
        want = [w for t in texts[at:] for w in words_of(t)]
        assert [one.words[i] for i in one.token.tolist()] == want


def test_words_are_spelled_without_an_object_each():
    texts = pa.array(["a  b\tC", None, "", " x\x0by ", "é\xa0z", "longer text with words", " "] * 5)
    _, counts = lmscore.kind_counts(texts)
    for some in (texts, texts.slice(3), texts.slice(2, 1), texts.slice(0, 0)):
        one = lmscore.Batch(some, lmscore.Topics(counts[:6]))
        flat, at, length, _ = one.flat
        lmscore.stretches(one)
        one.counts()
        assert "words" not in vars(one)
        assert flat.tobytes() == b"".join(w + b" " for w in one.words) and len(one.counts()) == len(one.words)
        assert [flat[a : a + n].tobytes() for a, n in zip(at, length)] == one.words


def test_states_against_sums_text_by_text():
    rnd = random.Random(7)
    texts = [None if i == 3 else " ".join(rnd.choice(["the", "of", "der", "und", "le", "toolong", "x"]) for _ in range(rnd.randrange(0, 12))) for i in range(40)]
    counts = np.random.default_rng(2).integers(0, 9, (5, 1 << lmscore.KIND_BITS)).astype(np.float32)
    topics = lmscore.Topics(counts)
    b = lmscore.Batch(texts, None)
    column = lmscore._kind_words(b)[b.token]
    want = []
    for start, n in zip(b.start, b.size):
        told, seen = np.zeros(topics.told.shape[1]), False
        for i in range(start, start + n):
            want.append(1 + int(told.argmax()) if seen else 0)
            if column[i] >= 0:
                told, seen = told + topics.told[column[i]], True
    assert topics.states(b).tolist() == want


def test_kinds_of_words_agree():
    """Short words count in one column, whether they are found in texts or among tokens; bytes are those that are spelled."""
    texts = ["the Cat  sat\ton", None, "", " é a toolong ab\n", "the the"]
    n, counts = lmscore.kind_counts(pa.array(texts))
    b = lmscore.Batch(texts, None)
    column = lmscore._kind_words(b)[b.token]
    row = np.repeat(np.arange(len(texts)), b.size)
    want = np.zeros_like(counts)
    np.add.at(want, (row[column >= 0], column[column >= 0]), 1)
    assert (counts == want).all() and counts.sum() == 9
    assert n[ord("t")] == 6 and n[ord("c")] == 1 and n[ord("C")] == 0 and n[lmscore.LINE] == 5


def test_words_of_texts_are_stored_in_few_bytes(spark):
    rnd = np.random.default_rng(3)
    vocabulary = np.array([f"w{i:x}" for i in range(20000)])
    texts = [" ".join(vocabulary[np.minimum(rnd.zipf(1.2, 400), 20000) - 1]) for _ in range(300)]
    d = spark.createDataFrame([(i, i % 7 == 2, t) for i, t in enumerate(texts)], "id long, held_out boolean, _text string").coalesce(1)
    model, n_bytes = lmscore.fitted(d.filter("NOT held_out").select("_text"))
    rows = lmscore.spelling(d, spark.sparkContext.broadcast(model), 1).filter(f"kind = {lmscore.TEXTS}").collect()
    n, stored = 0, 0
    for r in rows:
        _, token, *_ = pickle.loads(r.payload)
        n, stored = n + len(texts) * 401, stored + len(token)
    assert len(rows) == 1 and stored < 1.5 * n


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_rising_numbers_come_back(kind):
    rnd = np.random.default_rng(1)
    for x in (np.zeros(0, kind), np.array([np.iinfo(kind).max, 0, 5, 5, 3], kind), np.sort(rnd.integers(0, np.iinfo(kind).max, 1000, dtype=kind))):
        assert (lmscore._unpack_rising(lmscore._pack_rising(x), kind) == x).all()
