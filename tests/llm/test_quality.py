from seqloom.llm import quality

LONG = " ".join(f"word{i}" for i in range(60)) + "."


def brute(text):
    ws = (text or "").encode().split()
    ws = [w.decode() for w in ws]
    lines = [l for l in (text or "").split("\n") if l.encode().split()]
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(rep),
    }


TEXTS = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a a", LONG, LONG + "\n" + LONG, "x\x0b\x0cy z\xa0q é ### $$ 中文",
    "Home | About | Contact | Shop\n" + LONG, "\n".join(["Home | About | Contact | Shop | More | Help | Jobs"] * 30), "SHOUT!! " * 80,
    "Released under the MIT License.\n" + LONG, "z " * 30000, " ".join(str(i * 7919 % 1000) for i in range(20000)),
]


def test_against_brute_force(spark):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, _words int, kept int")
    got = {r.doc_id: r for r in quality.judge(d).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, repr(t)[:60]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i].base_failed == failed
        assert not (failed and got[i].kept)
    assert [got[i].kept for i in (7, 10, 13)] == [True] * 3
    assert not got[11].kept and not got[12].kept


def test_clean_text_and_empty(spark):
    d = spark.createDataFrame([(1, "Home | About | Contact | Shop\n" + LONG)], "doc_id long, text string")
    assert quality.judge(d, with_text=True).collect()[0].clean_text == LONG
    assert quality.judge(d.limit(0)).collect() == []
    assert quality.judge(d.union(d)).count() == 2
