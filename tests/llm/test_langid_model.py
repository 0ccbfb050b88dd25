"""Language identification step by step: counts of long texts, the leader and the temperature against plain loops."""

import random
from collections import Counter
from math import exp, log, sqrt

import numpy as np
import pytest

from scanloom.llm import langid


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 500])
def test_pieces_of_a_text_count_as_the_whole(monkeypatch, chunk):
    generator = random.Random(chunk)
    texts = ["", " ", "a", "1 2", "é  ß", "".join(generator.choice("abß Ä7.\t") for _ in range(700))]
    whole = [langid.counts_of(t) for t in texts]
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for w, t in zip(whole, texts, strict=True):
        found = langid.counts_of(t)
        assert (found is None and w is None) or (found == w).all()


def test_a_text_of_more_than_a_piece():
    text = "the weather is nice " * 60_000
    assert len(text) > langid.CHUNK
    grams = Counter()
    plain = " " + text.strip() + " "
    for n in langid.ORDERS:
        grams.update(Counter(plain[i : i + n] for i in range(len(plain) - n + 1)))
    found = langid.counts_of(text)
    assert found.sum() == sum(grams.values())
    assert sorted(found[found > 0]) == sorted(grams.values())


def test_leader_against_plain_loops():
    """Each coordinate's gradient sum and squares, kept in dictionaries; the weights follow from them at each step."""
    fit, classes, generator = langid.Fit(epochs=2), 3, random.Random(1)
    rows = []
    for _ in range(40):
        at = sorted(generator.sample(range(12), 4))
        values = np.array([generator.random() for _ in at])
        rows.append((np.array(at), values / np.sqrt((values**2).sum())))
    labels = np.array([generator.randrange(classes) for _ in rows])
    z, n = Counter(), Counter()

    def weight(f, c):
        pull = z[f, c]
        return 0.0 if abs(pull) <= fit.l1 else -(pull - (fit.l1 if pull > 0 else -fit.l1)) / ((fit.beta + sqrt(n[f, c])) / fit.alpha + fit.l2)

    order = np.random.default_rng(fit.seed)
    for _ in range(fit.epochs):
        for i in order.permutation(len(rows)):
            x = dict(zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True)) | {langid.FEATURES: 1.0}
            w = {(f, c): weight(f, c) for f in x for c in range(classes)}
            e = [exp(sum(v * w[f, c] for f, v in x.items())) for c in range(classes)]
            for c in range(classes):
                slope = e[c] / sum(e) - (labels[i] == c)
                for f, v in x.items():
                    g = v * slope
                    z[f, c] += g - (sqrt(n[f, c] + g * g) - sqrt(n[f, c])) / fit.alpha * w[f, c]
                    n[f, c] += g * g
    weights, bias = langid.fit_leader(rows, labels, classes, fit)
    assert weights[:12] == pytest.approx(np.array([[weight(f, c) for c in range(classes)] for f in range(12)]))
    assert bias == pytest.approx([weight(langid.FEATURES, c) for c in range(classes)]) and not weights[12:].any()


def test_temperature_against_a_grid():
    generator = np.random.default_rng(3)
    logits = generator.normal(size=(200, 3)) * 6
    labels = np.array([generator.choice(3, p=np.exp(r / 4) / np.exp(r / 4).sum()) for r in logits])
    loss = lambda t: float(np.mean([log(sum(exp(x / t) for x in r)) - r[y] / t for r, y in zip(logits, labels, strict=True)]))
    best = langid.best_temperature(logits, labels)
    assert loss(best) <= min(loss(t) for t in np.linspace(0.5, 15, 200)) + 1e-6
