"""Each text operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from scanloom.llm import char_lm, exact_dedup, langid, mixing, piece_codec, secrets, simhash, topk, toxicity
from scanloom.llm.components import components
from scanloom.llm.queries import piece_model, queries
from test_near_dedup import kept_by_brute_force


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values):
    """The root of each value, by all pairs within 3 bits."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    order = sorted(values)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {v: find(v) for v in order}


def test_simhash(spark, sf, rows):
    own = {r.doc_id: fingerprint(r.text) for r in rows}
    roots = linked(set(own.values()))
    least = defaultdict(lambda: 1 << 62)
    for i, f in own.items():
        least[roots[f]] = min(least[roots[f]], i)
    for r in queries()["op1_simhash"](spark, sf).collect():
        assert r.fingerprint == f"{own[r.doc_id]:016x}" and r.component_id == least[roots[own[r.doc_id]]]


def test_pairs_of_close_fingerprints(spark):
    generator = random.Random(5)
    values = set()
    for _ in range(12):
        base = generator.getrandbits(64)
        values |= {base ^ sum(1 << b for b in generator.sample(range(64), generator.randint(0, 3))) for _ in range(12)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    found = {frozenset((signed[r.a], signed[r.b])) for r in simhash.similar_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert found == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    assert simhash.similar_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).count() == len(found)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 30), (50, 50), (45, 40)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(21)} | {30: 30, 40: 30, 45: 30}


def test_topk_prunes_nothing_it_needs():
    generator = np.random.default_rng(2)
    queries_, there = generator.integers(-200, 200, (7, 40)), generator.integers(-200, 200, (300, 40))
    there[50:120] = there[50]  # ties
    ids, query_ids = generator.permutation(300), np.arange(7)
    query, place, score = topk.best_of_block(query_ids, queries_, ids, there.T, 20)
    for q in range(7):
        expected = sorted((-int(queries_[q] @ there[i]), int(ids[i])) for i in range(300) if ids[i] != query_ids[q])[:20]
        assert [(-int(s), int(ids[p])) for p, s in zip(place[query == q], score[query == q], strict=True)] == expected


def test_targets_and_taken(spark, sf, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_sources, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_sources -= over
    target |= {s: share * weight[s] for s in open_sources}
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    found = queries()["op3_mixing"](spark, sf).collect()
    for r in found:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(100, 0.03 * target[s]) for s in order)
    assert sorted(found) == sorted(queries()["op3_mixing"](spark, sf).collect())


def test_quotas_are_exact():
    draws = [0, 7, 100, 1000, 3]
    quotas = mixing.shard_quotas(draws, 6)
    assert quotas.sum(axis=1).tolist() == draws and quotas.sum(axis=0).max() - quotas.sum(axis=0).min() <= 1


def test_pieces_equal_the_library(spark, sf, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in queries()["op7_pieces"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_of_odd_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=piece_model()), piece_codec.codec(piece_model())
    generator = random.Random(1)
    alphabet = "aabcdeilnorst    .,!?0123\n\t▁éß漢🙂\x00<>/_-'\"ABT"
    texts = ["".join(generator.choice(alphabet) for _ in range(generator.randint(0, 60))) for _ in range(2000)] + [" " * 99, "the" * 3000, "<s></s><0x41>", "-" * 200]
    for t, ids in zip(texts, library.encode(texts), strict=True):
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids)


def test_trigram_queries_hold():
    generator = random.Random(3)
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert (query is None) == (rule.name == "hex")

    def holds(query, text):
        return True if query is None else query in text if isinstance(query, bytes) else (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    for pattern in ("ab(c|d+)ef{2}", "x?abc[0-9]+yz", "(foo|ba[rz])qux", "a.c", "(?:abc)*d", "hello( world)?!"):
        query = secrets.trigram_query(pattern)
        for _ in range(3000):
            text = "".join(generator.choice("abcdefxyz0foqru !helw") for _ in range(9))
            if re.search(pattern, text):
                assert holds(query, text.encode())
    assert holds(secrets.trigram_query("(foo|ba[rz])qux"), b"foobazqux") and not holds(secrets.trigram_query("(foo|ba[rz])qux"), b"fooqu")


def test_secrets(spark, sf, rows):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in queries()["op8_secrets"](spark, sf).collect():
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(texts[r.doc_id]) if ok(m))
        assert r.base_sha256 == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and luhn(re.sub(r"[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PERSONAL for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data(spark, sf, rows, tmp_path):
    generator = random.Random(4)
    alphabet = ["a@b.c", "@", ".", "1", "22", "255", "256", "+1 ", "-", " ", "x", "(9)", "4532 0151 1283 0366", "é", "_d@e.f", "0.0.0.0", "..", "+49"]
    odd = [(1_000_000 + i, "".join(generator.choice(alphabet) for _ in range(generator.randint(0, 25)))) for i in range(1500)]
    spark.createDataFrame([(r.doc_id, r.text) for r in rows] + odd, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text or "" for r in rows} | dict(odd)
    for r in queries()["op10_pii"](spark, str(tmp_path)).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k, _, _ in PERSONAL)


def test_personal_data_of_other_kinds(spark):
    from scanloom.llm import pii

    text = "my bank account is DE89 3704 0044 0532 0130 00 AND ssn 123-45-6789, not GB82 WEST 1234 5698 7654 33 nor 987-65-4321"
    found = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.kind, text[s.start : s.end]) for s in found if s.kind not in ("card", "phone")] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    out = spark.createDataFrame([(1, "write to a.b@c.de now")], "doc_id long, text string")
    spans = pii.find_personal_data(out).join(out, "doc_id").select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first().t
    assert spans == "write to <email> now"


def test_languages(spark, sf, docs):
    found = langid.identify(docs).select("row.doc_id", "row.lang", "lang_pred", "score").withColumn("out", langid.held_out("doc_id")).filter("out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_decoding():
    text = "you are an idiot and a worthless loser and such trash. the weather is nice today. " * 50
    counts = sum(np.bincount(c, minlength=char_lm.SIZE) for c in char_lm.trigrams(text))
    model = toxicity.Reader(char_lm.losses(counts))
    assert toxicity.restored("An 1d10t, a l0ser: w0rthless TR@SH, l.o.s.e.r, i d i o t, loooooser", model) == "an idiot, a loser: worthless trash, loser, idiot, loser"
    assert toxicity.restored("plain words, 2024 and v2.0", model) == "plain words, 2024 and v2.0"


def test_toxicity_of_held_out(spark, tmp_path):
    generator = random.Random(6)
    plain = ["".join(generator.choice(["ba", "ko", "mi", "tu", "re", "so"]) for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [generator.choice(plain) for _ in range(30)]
        if toxic := i % 5 == 0:
            words[generator.randrange(30)] = generator.choice(("blarg", "snork"))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = queries()["op5_toxicity"](spark, str(tmp_path)).filter("held_out").collect()
    assert len(found) > 200 and all(r.predicted == int(r.doc_id % 5 == 0) for r in found)


def test_lm_scores(spark, sf):
    found = {r.doc_id: r for r in queries()["op4_lm_scoring"](spark, sf).collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = ([found[i].score for i, q in quality.items() if q == x and i in found] for x in (1, 0))
    assert np.mean([g < b for g in good for b in bad]) > 0.9


def test_pipeline(spark, sf, rows):
    """The stages against plain loops: what is kept, how often, and how it is encoded."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    found = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).select("row.doc_id", "lang_pred", "score").collect()}
    known = [r for r in rows if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= 0.5]
    first = {}
    for r in sorted(known, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r.text), r)
    stay = kept_by_brute_force({r.doc_id: r.text for r in first.values()})
    kept = {r.doc_id: r for r in first.values() if r.doc_id in stay}
    texts = {r.doc_id: r for r in kept.values()}
    times = Counter(r.doc_id for r in out)
    assert set(times) <= set(texts) and max(times.values()) <= 3
    mixed = {r.doc_id: len(r.shards) for r in mixing.mix(spark.createDataFrame([tuple(r) for r in kept.values()], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert times == Counter({i: n for i, n in mixed.items() if n})
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id].text)


def test_hot_texts(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(900)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.keep_id for r in found if r.doc_id % 3} == {1} and {r.group_size for r in found if r.doc_id % 3} == {600}
    assert sum(r.kept for r in found) == 301
