"""Encoding of long runs and of texts in parts, and decoding from ids alone, against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from scanloom.llm import piece_codec
from scanloom.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def own():
    return piece_codec.codec(piece_model())


def test_a_run_of_five_megabytes(library, own):
    generator = random.Random(1)
    run = "".join(generator.choice("etaoins") for _ in range(5 << 20))
    ids = own.encode(run)
    assert ids == library.encode(run) and own.decode(ids) == run
    assert run not in own._memory and own._bytes <= piece_codec.REMEMBERED_BYTES + (64 << 20)


def test_parts_of_a_text(library, own, monkeypatch, spark):
    monkeypatch.setattr(piece_codec, "BATCH_CHARS", 40)
    texts = ["plain words  and   blanks " * 20, " " * 300, "x" * 300 + " y", "\t\n é 日本 😀 " * 30, "a▁b ▁ c" * 30, "", None]
    for t in texts:
        ids = library.encode(t or "")
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids)
    rows = piece_codec.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), piece_model()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_decoding_knows_ids_only(library, own):
    generator = random.Random(3)
    ids = [i for i in (generator.randrange(own.tokens) for _ in range(2000)) if not library.is_byte(i) and not library.is_control(i) and not library.is_unknown(i)]
    assert own.decode(ids) == library.decode(ids)


def test_pair_tests_agree(own):
    generator = np.random.default_rng(2)
    tokens = np.array(sorted(own.reached))
    a, b = generator.choice(tokens, 3000), generator.choice(tokens, 3000)
    assert [own._may_follow(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)] == own._compatible(a, b).tolist()


def test_runs_that_come_again_stay_remembered(library, monkeypatch):
    """Runs in each text are learned once, though others fill the memory many times over; both halves keep their bound."""
    own, learned = piece_codec.PieceCodec(piece_model()), []
    own.remembered = 200_000
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda runs: (learned.extend(runs), learn(runs)))
    generator = random.Random(4)
    for _ in range(40):
        text = "the words that come again " + " ".join("".join(generator.choice("etaoinsr") for _ in range(9)) for _ in range(300))
        assert own.encode(text) == library.encode(text)
        assert sum(map(len, own._memory)) <= own._bytes <= 200_000 and len(own._memory) + len(own._before) <= 2000
    assert len(learned) > 10_000 and learned.count(piece_codec.SEPARATOR + "again") == 1
