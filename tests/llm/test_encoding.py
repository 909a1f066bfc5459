import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json")), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(encoding.vocabulary_file())


TEXTS = [None, "", " ", "\n\n\t ", "<|endoftext|>", "it's we'LL", "été 中文 🙂👩‍🔬", "a" * 3000, " " * 1000, "0" * 500, "ab" * 700, "\u0000�", "x​y"]


def test_hard_texts(encoder, reference):
    assert list(encoder.encode_many(TEXTS)) == reference(TEXTS)


def test_random_texts(encoder, reference):
    rng = random.Random(0)
    texts = ["".join(rng.choice("aAbethinst 's0123\n  éЖ中🙂_-{}<|>") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert list(encoder.encode_many(texts)) == reference(texts)


def merged(encoder, data):
    """Plain merging of the bytes, pair of lowest rank first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((encoder.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [encoder.ids[p] for p in parts]


def test_tokens_side_by_side(encoder):
    rng, tokens = random.Random(2), sorted(encoder.tokens)
    short = [t for t in tokens if len(encoder.tokens[t]) <= 2]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(4000)] + [(rng.choice(short), rng.choice(short)) for _ in range(4000)]
    for t in rng.sample(tokens, 2000):  # the parts of one token, most of which don't stay apart
        data = encoder.tokens[t]
        pairs += [(encoder.ids[data[:i]], encoder.ids[data[i:]]) for i in range(1, len(data)) if data[:i] in encoder.ids and data[i:] in encoder.ids]
    for a, b in pairs:
        assert encoder.may_follow(a, b) == (merged(encoder, encoder.tokens[a] + encoder.tokens[b]) == [a, b]), (a, b)


def test_texts_of_random_tokens(encoder, reference):
    rng, tokens = random.Random(3), sorted(encoder.tokens)
    texts = [b"".join(encoder.tokens[rng.choice(tokens)] for _ in range(rng.randrange(1, 30))).decode(errors="ignore") for _ in range(1500)]
    assert list(encoder.encode_many(texts)) == reference(texts)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(text):
    e, t = test_any_text.encoder, test_any_text.reference
    assert list(e.encode_many([text])) == t([text])


@pytest.fixture(autouse=True)
def _attach(encoder, reference):
    test_any_text.encoder, test_any_text.reference = encoder, reference


def test_store_of_words_may_start_anew(reference):
    e = encoding.Encoder(encoding.vocabulary_file(), kept_words=3)
    texts = ["one two three", "four five six seven", "one eight", "two"]
    for t in texts:
        assert list(e.encode_many([t])) == reference([t])


def test_table(spark, reference):
    rows = [(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(None, "ab", 1, "y"), (3, "again", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, tokens string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encoding.encoded(df).collect()), key=repr)
    assert got == sorted(((r[0], i) for r, i in zip(rows, reference([r[1] for r in rows]), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.tokens) for r in encoding.token_counts(df).collect()), key=repr) == sorted(((a, len(b)) for a, b in got), key=repr)
    assert encoding.encoded(df.where("false")).count() == 0
