import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return bpe.loaded(bpe.default_path())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def texts():
    rnd = random.Random(7)
    alphabet = "abethr  \n\t's'll0129éßñ中文🙂.,!$%\x00\x1c\x85\xa0 　​"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(400)]
    return ["", " ", "aaaa aaaaa", "a" * 5000, "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "<|endoftext", "don't we'll I'd", "  lead\n\n trail  ", *made]


def test_ids_and_text_as_the_library(spark, library):
    ts = texts()
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ts, None])], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(d, with_ids=True).collect()}
    for i, t in enumerate([*ts, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == want, repr(t)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        back = library.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_decode_round_trip(spark):
    ts = texts()
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(d, with_ids=True)).withColumnRenamed("text", "back")
    assert d.join(back, "doc_id").filter(F.col("text") != F.col("back")).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text == ""


def test_partial_characters_decode_as_the_library(model, library):
    ids = library.encode("é🙂", add_special_tokens=False).ids
    for cut in (ids[:1], ids[:-1], ids[1:], ids[::-1]):
        assert model.decode(cut) == library.decode(cut, skip_special_tokens=False)


def test_empty_table_and_repeats(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(e).collect() == []
    two = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len(bpe.encode(two).collect()) == 2


@pytest.mark.parametrize("long", [1, 3, 1 << 30])
def test_merges_of_long_lists_as_place_by_place(model, library, monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    # pairs of one symbol that overlap, in words of even and odd lengths, beside each other and repeated
    words = sorted({w for t in texts() for w in model.pretokens(t) if w not in model.special} | {"a" * n for n in range(1, 40)} | {"ab" * n + "b" for n in range(9)} | {" " * n for n in range(1, 30)})
    words += words[:50]
    assert model.encode_words(words) == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert model.encode_words([]) == []
