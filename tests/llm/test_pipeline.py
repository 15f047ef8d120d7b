import hashlib
import random

import pytest

import corpus_pipeline
from seqloom.llm import bpe, mixing, neardup, secrets

EN = "the quick brown fox jumps over lazy dog and then it was gone with wind that blew over there every day of year".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann war er mit dem wind verschwunden jeden tag im jahr".split()


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        k, w = [("en", EN), ("de", DE)][i % 2]
        t = " ".join(rnd.choice(w) for _ in range(60))
        if i % 10 == 3:
            t += ' token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" ' + rnd.choice(w)
        rows.append((i, t, k, f"s{i % 3}", len(t)))
    rows += [(100 + i, rows[i][1] + " " + rnd.choice(EN), rows[i][2], "s0", 1) for i in range(8)]
    rows += [(200, None, "en", "s1", None), (201, "123 456 --", "en", "s1", 10), (202, "", None, None, 0), (203, rows[0][1].upper(), None, None, 3)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages_against_plain_steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe"]
    frames = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, folder)
        if name != "bpe":
            assert out.columns == docs.columns
        frames[name] = out.toPandas()
        docs = spark.createDataFrame(out.collect(), out.schema)
    said = frames["language_id"]
    assert not set(said.doc_id) & {200, 201, 202} and said.lang.notna().all()
    kept = frames["near_dedup"]
    sets = {r.doc_id: set(neardup.shingle_sets(__import__("pyarrow").array([r.text]))[0].tolist()) for r in said.itertuples()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert set(kept.doc_id) == {i for i in sets if find(i) == i}
    clean = frames["secret_scan"]
    assert len(clean) == len(kept)
    for a, b in zip(kept.sort_values("doc_id").text, clean.sort_values("doc_id").text):
        assert b == a.replace("f33e61083db5dbdf4bd2369d2f80176e57f7fda2", secrets.MASK)
    plan = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(clean)).collect()}
    mixed = frames["mixing"]
    assert mixed.groupby("doc_id").size().to_dict() == {i: n for i, n in plan.items() if n}
    model = bpe.loaded(bpe.default_path())
    text = mixed.drop_duplicates("doc_id").set_index("doc_id").text
    for r in frames["bpe"].itertuples():
        ids = [i for w in model.encode_words(model.pretokens(text[r.doc_id])) for i in w]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_same(spark, folder):
    a = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert a == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) and a


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(EN[i % 7 * (i % 3)] for i in range(5000))


def odd_rows():
    a, b = " ".join(EN), " ".join(DE)
    # no id, no text, rows alike in all, two texts under one id, a copy under another id, a long text
    return [(None, a, "en", "a", 1), (None, a, "en", "a", 1), (1, None, None, None, None), (1, b, "de", "a", 1), (1, a + " more of it here now", "en", "a", 1), (2, b, "de", "b", 2), (2, b, "de", "b", 2), (3, LONG, "en", None, 1), (4, "", "en", "a", 0), (4, "", "en", "a", 0)]


def seen(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_odd_rows_stage_by_stage(spark, folder):
    rows = odd_rows()
    d = spark.createDataFrame(rows, SCHEMA)
    told = seen(corpus_pipeline.languages(spark, d, folder))
    assert told == sorted(((r[0], r[1]) for r in rows if r[1]), key=str)
    # one row of each text is left, all rows without words stay, both texts of id 1 are judged for themselves
    near = corpus_pipeline.near_duplicates(spark, d, folder)
    assert near.columns == d.columns
    texts = sorted((t for _, t in seen(near)), key=str)
    assert texts == sorted([rows[0][1], None, rows[3][1], LONG, "", "", *([rows[4][1]] if (1, rows[4][1]) in seen(near) else [])], key=str)
    assert seen(corpus_pipeline.secret_scan(spark, d, folder)) == sorted(((r[0], r[1]) for r in rows), key=str)
    taken = sum(r["size"] * r.copies for r in mixing.plan(d).collect())
    assert sum(len((t or "").split()) for _, t in seen(corpus_pipeline.mix(spark, d, folder))) == taken
    tokens = corpus_pipeline.encode(spark, d, folder).collect()
    assert len(tokens) == len(rows) and sorted(r.n_tokens for r in tokens)[:3] == [0, 0, 0]


def test_two_texts_of_one_id_both_stay(spark, folder):
    rows = [(1, " ".join(EN), "en", "s", 1), (1, " ".join(DE), "de", "s", 1), (2, " ".join(DE), "de", "s", 1), (3, "alone here", "en", "s", 1)]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert sorted(r.text for r in left) == sorted([" ".join(EN), " ".join(DE), "alone here"])


def test_empty_frames(spark, folder):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], SCHEMA), folder).collect() == [], name


def test_names_that_clash(spark, folder):
    """Columns named as the stages' own."""
    extra = ["_id", "_row", "_key", "_n", "_gone", "_text", "_m", "_told", "size", "copies", "target", "id", "count", "n_tokens_"]
    rows = [(*r, *[i] * len(extra)) for i, r in enumerate(odd_rows())]
    d = spark.createDataFrame(rows, SCHEMA + "".join(f", {x} int" for x in extra))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, folder)
        assert out.columns == d.columns and out.count() > 0, name
    assert corpus_pipeline.encode(spark, d, folder).count() == len(rows)


def test_near_copies_from_80_percent(spark, folder):
    base = [f"w{i}" for i in range(204)]
    # 179 of 221, and 174 of 226 shingles are shared with the first
    texts = [base, [f"y{i}" for i in range(21)] + base[21:], base[:178] + [f"z{i}" for i in range(26)]]
    d = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, folder).collect()} == {0, 2}
