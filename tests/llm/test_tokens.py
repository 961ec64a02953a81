import os
import random

import numpy as np
import pytest

from cinetable.llm.containers import differencing, fill_containers, pack, pack_documents
from cinetable.llm.tokens import LONG_WORD, TOKENIZERS, Encoder, Vocabulary, token_counts, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary.load())


@pytest.fixture(scope="module")
def public():
    found = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda texts: [x.ids for x in found.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_public_tokenizer(encoder, public):
    rng = random.Random(0)
    texts = ["", " ", "hello world", "<|endoftext|> don't we'll", "a\n\n  b", "日本語 текст 👍🏽", "é", "x" * LONG_WORD, "x" * (LONG_WORD + 1), "ha" * 3000]
    for _ in range(300):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x3040, 0x3100), 32, 10])) for _ in range(60)))
    assert [list(ids) for ids in encoder.encode(texts)] == public(texts)
    assert encoder.count(texts) == [len(ids) for ids in public(texts)]


def test_both_contractions_agree(encoder):
    rng = random.Random(1)
    for _ in range(60):
        word = "".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(1, 80)))
        encoder.learn({word})
        assert encoder.known[word] == encoder._by_heap(word.encode())


def test_few_words_are_kept(monkeypatch, public):
    from cinetable.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_WORDS", 10)
    monkeypatch.setattr(tokens, "ROWS_PER_QUERY", 50)
    small = Encoder(Vocabulary.load())
    texts = [" ".join(f"w{i}{j}" for j in range(12)) for i in range(8)]
    for text in texts:
        assert [list(x) for x in small.encode([text])] == public([text])


def test_operator(spark, public):
    rows = [(1, "hello", "k"), (2, "", "k"), (3, None, "k"), (1, "hello", "k"), (4, "many words " * 30_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in token_ids(df).collect())
    assert got == sorted([(1, public(["hello"])[0]), (1, public(["hello"])[0]), (2, []), (3, []), (4, public([rows[4][1]])[0])])
    assert token_ids(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()}[3] == 0


@pytest.mark.parametrize("count", [1, 2, 5])
def test_differencing_places_every_item(count):
    sizes = np.array([9, 7, 5, 5, 3, 1, 0, 2])
    place, sums = differencing(sizes, count)
    assert sorted(np.bincount(place, weights=sizes, minlength=count).tolist()) == sorted(sums.tolist())
    assert sums.max() - sums.min() <= 9


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    for sizes, most in ((rng.integers(1, 900, 2000), 0.975), (np.full(50, 2100), 0.5), (np.array([4096] * 5 + [1]), 0.8)):
        place = pack(sizes, 4096)
        sums = np.bincount(place, weights=sizes)
        assert sums.max() <= 4096 and len(place) == len(sizes)
        assert sizes.sum() / (len(sums) * 4096) >= most
    assert len(pack(np.array([], dtype=np.int64), 10)) == 0 and pack(np.zeros(3, dtype=np.int64), 10).tolist() == [0, 0, 0]


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 50, 99, 100, 101, 250, 300, 12345])) for i in range(500)] + [(1, 60), (None, 20), (7, None), (8, -3)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    out = fill_containers(df, "doc_id", "n", capacity=100).collect()
    used = {}
    for r in out:
        used[r.container] = used.get(r.container, 0) + r.piece_end - r.piece_start
        assert 0 <= r.piece_end - r.piece_start <= 100
    assert max(used.values()) <= 100 and sum(used.values()) == sum(max(n or 0, 0) for _, n in rows)
    assert sum(r.piece == 0 for r in out) == len(rows)
    whole = [r for r in out if r.doc_id == 499]
    assert len(whole) == max(1, -(-rows[499][1] // 100))
    assert fill_containers(df.limit(0), "doc_id", "n").count() == 0


def test_packed_documents(spark):
    rows = [(i, "word " * n) for i, n in enumerate([10, 0, 3000, 5000, 9000])] + [(5, None)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=4096).collect()
    assert {r.doc_id for r in out if r.piece == 1} == {3, 4} and {r.doc_id for r in out} == set(range(6))
