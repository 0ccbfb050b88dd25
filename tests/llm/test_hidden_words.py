"""Hidden words: the decoder against an exhaustive search, and what it finds of words hidden by all means."""

import random
import re
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from scanloom.llm import char_lm, toxicity


def reader_of(text):
    return toxicity.Reader(char_lm.losses(sum(np.bincount(c, minlength=char_lm.SIZE) for c in char_lm.trigrams(text))))


@pytest.fixture(scope="module")
def reader():
    return reader_of("you are an idiot and a worthless loser, a moron, a boob and such trash, asshole. the weather is nice today. " * 50)


def words_of(text, reader):
    return {w for _, words in reader.pieces(text.lower()) for w in words}


@pytest.mark.parametrize(("hidden", "word"), [("worthle$$", "worthless"), ("worth1e55", "worthless"), ("a$$hole", "asshole"), ("1d!0t$$$", "idiot"), ("1 d i o t", "idiot"), ("$.u.c.h", "such"), ("x" * 50 + "-tr@sh", "trash"), ("b00b", "boob")])
def test_signs(reader, hidden, word):
    assert word in toxicity.WORD.findall(toxicity.restored(f"such {hidden} today", reader))


@pytest.mark.parametrize(("hidden", "word"), [("l00ser", "loser"), ("m00r00n", "moron"), ("loser123", "loser"), ("l0ser99", "loser"), ("(i d i o t)", "idiot"), ("t-r-a-s-h", "trash"), ("looooser", "loser")])
def test_readings(reader, hidden, word):
    assert word in words_of(f"such {hidden}, today", reader)


def test_clean_words_stay(reader):
    for text in ("loser123 and weather24", "1.2.3.4 and 1 2 3", "plain words, 2024 and v2.0", "a b  c\n\td"):
        assert toxicity.restored(text, reader) == text


@pytest.mark.parametrize("before", range(8))
def test_long_spelt_runs(reader, before):
    spelt = " ".join("weatherisnicetoday"[:before] + "theweatherisnicetoday" * 2 + "idiot")
    assert "idiot" in toxicity.restored(spelt, reader).replace(" ", "")


def test_long_tokens(reader):
    assert toxicity.restored("l0ser" * 2000, reader) == "loser" * 2000
    assert toxicity.restored("-".join("trash" * 12), reader) == "trash" * 12


def test_decoder_is_exhaustive(reader):
    """The reading has the least cost of all that the lattice holds."""
    table, n = char_lm.classes(), char_lm.CLASSES

    def cost(path):
        total, a, b = 0.0, 0, int(table[32])
        for x, extra in [*path, (" ", 0.0)]:
            total += extra
            if x:
                k = int(table[ord(x)])
                total, a, b = total + float(reader.losses[(a * n + b) * n + k]), b, k
        return total

    generator = random.Random(4)
    for _ in range(150):
        token = "".join(generator.choice("aeilost01!|$39") for _ in range(generator.randint(1, 7)))
        token = generator.choice((token, " ".join(token[:5]), ".".join(token[:5]), token + token[-1] * 3))
        every = min(map(cost, product(*toxicity.lattice(token))))
        reading, found = toxicity.decode(token, reader.losses)
        assert found == pytest.approx(every) and "".join(x for x in reading if x != " ").isprintable()


def hidden(word, kind, generator):
    signs = {}
    for sign, letters in toxicity.STANDS_FOR.items():
        for x in letters:
            signs.setdefault(x, []).append(sign)
    if kind == "signs":
        at = [i for i, c in enumerate(word) if c in signs and (i < len(word) - 1 or True)]
        chosen = set(generator.sample(at, min(len(at), 2)))
        return "".join(generator.choice([s for s in signs[c] if s not in "!|(+"] or signs[c]) if i in chosen else c for i, c in enumerate(word))
    if kind == "repeated":
        i = generator.randrange(len(word))
        return word[:i] + word[i] * 4 + word[i:]
    return {"blanks": " ", "dots": ".", "dashes": "-"}[kind].join(word)


def test_recall_of_hidden_words():
    """Of words of the given documents, hidden in turn by each means, nine in ten are among the readings."""
    text = " ".join(t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t).lower()
    reader, generator = reader_of(text), random.Random(5)
    words = sorted(set(re.findall(r"(?<!\S)[a-z]{5,10}(?!\S)", text)))
    chosen, kinds = generator.sample(words, 400), ("signs", "repeated", "blanks", "dots", "dashes")
    found = {k: np.mean([w in words_of(f"and {hidden(w, k, generator)} then", reader) for w in chosen]) for k in kinds}
    assert min(found.values()) >= 0.9, found


def test_score_is_the_best_of_all_readings(reader):
    chances = {"loser": 0.9, "idio~": 0.8, "moron": 0.75, "nice": 0.1}
    scorer = toxicity.Scorer(reader, chances)
    for text in ("A l00ser, such", "m 0 r o n today", "1d!otic weather, nice", "nice", "", "plain words", "x (i d i o t s) loooser"):
        words = {w for _, ws in reader.pieces(text.lower()) for w in ws}
        best = max(((chances[f], f) for w in words for f in toxicity.features_of(w) if f in chances), default=(0.0, ""))
        assert scorer.score(text) == best == scorer.score(text)


def test_lexicon_against_plain_counts(spark, reader):
    """The chance of each feature from sets of documents, and of the words before it, counted in plain Python."""
    generator, fit = random.Random(9), toxicity.Fit(prior=1e-3)
    vocabulary = ["nice", "weather", "today", "such", "blarg", "snork", "l0ser", "worthless", "worthwhile"]
    rows = [(i, " ".join(generator.choice(vocabulary[:4] + (vocabulary[4:] if i % 3 == 0 else vocabulary[7:])) for _ in range(9))) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows] + [(3, 0), (None, 1), (5, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = toxicity.learn_lexicon(docs, spark.createDataFrame(labels, "id long, toxic int"), "key", spark.sparkContext.broadcast(reader.losses), fit)
    toxic, clean, places = {}, {}, {}
    for i, text in rows:
        before = ""
        for word in (w for _, ws in reader.pieces(text) for w in ws):
            for f in toxicity.features_of(word):
                (toxic if i % 3 == 0 else clean).setdefault(f, set()).add(i)
                if i % 3 == 0:
                    places.setdefault(f, set()).add(toxicity.crc32((word if f.endswith("~") else before).encode()) & 63)
            before = word
    base, expected = 100 / 300, {}
    for f, ids in toxic.items():
        n = len(places[f])
        contexts = -64 * np.log(1 - n / 64) if n < 64 else len(ids)
        evidence = min(len(ids), contexts) * np.log(fit.pure / base) + len(clean.get(f, ())) * np.log((1 - fit.pure) / (1 - base)) + np.log(fit.prior / (1 - fit.prior))
        if (chance := 1 / (1 + np.exp(-evidence))) >= fit.least:
            expected[f] = chance
    assert found == pytest.approx(expected) and {"blarg", "snork", "loser"} <= set(found) and "nice" not in found
