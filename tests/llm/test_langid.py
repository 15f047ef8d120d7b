import numpy as np
import pytest

from seqloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it was gone with the wind that blew over there"
DE = "der schnelle braune fuchs springt über den faulen hund und dann war er mit dem wind verschwunden weg"
ES = "el rápido zorro marrón salta sobre el perro perezoso y luego se fue con el viento que soplaba allí"


def rows(n=60):
    rnd = np.random.default_rng(3)
    return [(i, " ".join(rnd.permutation(t.split())[:14]), k, "x") for i, (k, t) in enumerate([("en", EN), ("de", DE), ("es", ES)] * n)]


def kernel(a, b):
    """By set operations: presence, blended, normalised."""
    return len(set(a) & set(b)) / np.sqrt(len(a) * len(b))


def test_kernel_is_shared_features():
    a, b = langid.features(EN), langid.features(DE)
    m = np.zeros((2, langid.N_FEATURES))
    m[0, a], m[1, b] = 1 / np.sqrt(len(a)), 1 / np.sqrt(len(b))
    assert np.isclose(m[0] @ m[1], kernel(a, b))


def test_features_are_the_ngrams():
    t = "AbÉ ab"
    raw = t.encode().lower()
    grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    assert len(langid.features(t)) <= len(grams)
    assert set(raw) == {x for x in langid.features(t) if x < 256}
    for short in ("a", "ab"):
        assert len(langid.features(short)) == {1: 1, 2: 3}[len(short)]


def test_held_out_accuracy(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    langs, matrix = langid.fit(langid.training_rows(d.filter(~langid.held_out())))
    assert langs == ["de", "en", "es"]
    out = langid.identify(d.withColumn("held_out", langid.held_out()), langs, matrix, keep=("doc_id", "held_out", "lang")).toPandas()
    h = out[out.held_out]
    assert len(h) > 20 and (h.lang == h.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_edge_texts(langs):
    matrix = np.ones((langid.N_FEATURES, len(langs)), np.float32)
    said, score = langid.predict([None, "", "12 34 !", "a", "é" * 100000], langs, matrix)
    assert said[:3] == ["und"] * 3 and score[:3] == [0.0] * 3
    assert said[3:] == (["en"] * 2 if langs else ["und"] * 2)


def test_empty_and_null_labels(spark):
    e = spark.createDataFrame([], "doc_id long, text string, lang string")
    langs, matrix = langid.fit(langid.training_rows(e))
    assert langs == [] and langid.identify(e, langs, matrix).collect() == []
    n = spark.createDataFrame([(None, EN, None), (1, EN, None), (1, EN, None)], "doc_id long, text string, lang string")
    assert langid.training_rows(n) == []
    assert [r.lang_pred for r in langid.identify(n, langs, matrix).collect()] == ["und"] * 3


def test_as_a_column(spark):
    d = spark.createDataFrame(rows(20), "doc_id long, text string, lang string, source string")
    langs, matrix = langid.fit(langid.training_rows(d))
    told = langid.judged(spark, langs, matrix)
    a = {(r.doc_id, r.p.lang_pred, r.p.score) for r in d.select("doc_id", told("text").alias("p")).collect()}
    assert a == {tuple(r) for r in langid.identify(d, langs, matrix).collect()}


def test_scores_against_kernel_ridge_regression():
    """With every training text a landmark the map spans the kernel, and the margins are those of the dual solution."""
    rs = [(k, langid.features(t)) for _, t, k, _ in rows(8)]
    langs, matrix = langid.fit(rs, landmarks=3 * len(rs), ridge=0.5)
    k = np.array([[kernel(a.tolist(), b.tolist()) for _, b in rs] for _, a in rs])
    y = np.array([[1.0 if l == g else -1.0 for g in langs] for l, _ in rs])
    size = {l: sum(x == l for x, _ in rs) for l in langs}
    weight = np.array([len(rs) / len(langs) / size[l] for l, _ in rs])
    alpha = np.linalg.solve(k + np.diag(0.5 * len(rs) / len(langs) / weight), y)
    for t in (EN[:30], DE[20:], ES, "neither of them", "ob es geht"):
        f = langid.features(t)
        want = np.array([kernel(f.tolist(), b.tolist()) for _, b in rs]) @ alpha
        x = np.zeros(langid.N_FEATURES, np.float32)
        x[f] = 1 / np.sqrt(len(f))
        assert np.allclose(x @ matrix, want, atol=1e-3)
        said, score = langid.predict([t], langs, matrix)
        assert said == [langs[int(want.argmax())]] and np.isclose(score[0], min(1, max(0, (want.max() + 1) / 2)), atol=1e-3)


def test_languages_of_short_texts_are_learned(spark):
    d = spark.createDataFrame([(i, ("uvw xyz", "q")[i % 2] if i % 3 == 0 else EN, "zz" if i % 3 == 0 else "en") for i in range(60)], "doc_id long, text string, lang string")
    langs, matrix = langid.fit(langid.training_rows(d))
    assert langs == ["en", "zz"]
    assert [r.lang_pred for r in langid.identify(d, langs, matrix).orderBy("doc_id").limit(4).collect()] == ["zz", "en", "en", "zz"]
