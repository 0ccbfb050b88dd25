"""The pipeline's near copies against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from scanloom.llm import near_dedup
from scanloom.llm.components import components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(texts):
    """Ids that stay: texts by id, all pairs held against each other."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in order if find(i) == i}


def test_stage_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == kept_by_brute_force({r.doc_id: r.text for r in docs.collect()})


def test_near_copies_of_many_kinds(spark):
    generator = random.Random(7)
    word = lambda: "".join(generator.choice("abcdefgh") for _ in range(5))
    texts = ["", None, " ", "one two", "ONE two", "one two three"]
    for changes in (1, 1, 2, 3, 4, 5, 6, 8):
        base = [word() for _ in range(generator.randint(60, 160))]
        for _ in range(12):
            own = list(base)
            for _ in range(changes):
                own[generator.randrange(len(own))] = word()
            texts.append(" ".join(own))
    by_id = dict(enumerate(texts))
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.keep_one_of_each_group(docs).collect()} == kept_by_brute_force(by_id)


def test_leaders_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_A_TEXT", 0)  # rounds of leaders until no pair is left
    sets = {i: list(range(i, i + 20)) for i in range(30)}  # neighbours are similar, others not
    buckets = spark.createDataFrame([(k, i) for i in sets for k in (0, i % 2 - 5)], "key long, node long")
    found = near_dedup.linked(buckets, spark.createDataFrame(list(sets.items()), "node long, hashes array<long>"), 30)
    assert {r.node: r.root for r in found.collect()} == dict.fromkeys(range(30), 0)


def test_dense_group_in_several_homes(spark, monkeypatch):
    """One group of many near copies, of which many pairs are below 0.8: few sets a home, and few pairs before leaders."""
    monkeypatch.setattr(near_dedup, "HOME_SETS", 8)
    monkeypatch.setattr(near_dedup, "PAIRS_A_TEXT", 1)
    generator = random.Random(3)
    word = lambda: "".join(generator.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for i in range(140):
        own = list(base)
        for _ in range(generator.choice((1, 2, 3, 4, 5))):
            own[generator.randrange(len(own))] = word()
        texts.append(" ".join(own))
    by_id = dict(enumerate(texts))
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").repartition(7)
    assert {r.doc_id for r in near_dedup.keep_one_of_each_group(docs).collect()} == kept_by_brute_force(by_id)


def test_components_that_end_early_join_only_what_is_linked(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (102, 101), (7, 7)], "a long, b long")
    whole = {r.node: r.root for r in components(links).collect()}
    assert whole == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)
    for rounds in (0, 1, 2):
        found = components(links, rounds).collect()
        assert len(found) == len(whole) and all(whole[r.node] == whole[r.root] and r.root <= r.node for r in found)


def test_ends_within_two_links(spark):
    """Each end goes to the least one within two links, itself and repeated links included; one root means one component."""
    generator = random.Random(11)
    links = [(i + 1, i) for i in range(12)] + [(generator.randrange(20, 60), generator.randrange(20, 60)) for _ in range(30)] + [(90, 90), (95, 99), (95, 99)]
    near = {}
    for a, b in links:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    expected = {x: min(z for y in near[x] for z in near[y]) for x in near}
    found = near_dedup._nearby(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(expected) and {r.old: r.new for r in found} == expected


def test_members_carry_their_buckets_and_home(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOME_SETS", 4)
    pairs = [(1, n) for n in range(10)] + [(2, n) for n in (0, 1, 2)] + [(3, 50), (4, 60), (4, 61)]
    found = near_dedup._members(spark.createDataFrame(pairs, "key long, node long")).collect()
    assert {r.node for r in found} == {*range(10), 60, 61}  # 50 shares no bucket
    sizes = {1: (10, 9), 2: (3, 2), 4: (2, 61)}
    for r in found:
        own = {key for key, node in pairs if node == r.node}
        assert {(b.key, b.n, b.top) for b in r.buckets} == {(k, *sizes[k]) for k in own}
        assert r.weight == sum(sizes[k][0] for k in own)
    homes = {r.node: r.home for r in found}
    assert homes[60] == homes[61] and 1 <= len({homes[n] for n in range(10)}) <= 3


def bits_of(hashes):
    return np.unpackbits(np.frombuffer(near_dedup.fingerprint(hashes), np.uint8))


def random_set(generator, n):
    return np.sort(generator.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def test_fingerprint_is_the_majority_of_each_bit():
    generator = np.random.default_rng(1)
    for n in (1, 2, 5, 255, 256, 700):
        own = random_set(generator, n)
        words = [[(int(h) * int(f) % (1 << 64)) >> 32 for f in near_dedup._FACTORS] for h in own]
        plain = ["".join(f"{w.to_bytes(4, 'little')[i]:08b}" for w in row for i in range(4)) for row in words]
        expected = [int(2 * sum(row[i] == "1" for row in plain) > n) for i in range(near_dedup.BITS)]
        assert bits_of(own).tolist() == expected


def test_simhash_segments_find_pairs_of_the_least_similarity():
    """Of 3,000 pairs of 0.8 to 0.82 each agrees in a segment and is close in the other bits, whatever the number of texts."""
    generator = np.random.default_rng(2)
    assert near_dedup.segment_places(100).shape == (16, 4)
    for shared, more, others in ((4, 0, 1), (5, 0, 1), (8, 1, 1), (16, 2, 2), (80, 10, 10), (82, 0, 20)):
        pairs = []
        for _ in range(500):
            both = random_set(generator, shared)
            x, y = (np.sort(np.append(both, random_set(generator, n))) for n in (more, others))
            looked_up = [np.frombuffer(near_dedup.fingerprints(s), np.uint8).reshape(-1, near_dedup.BITS // 8) for s in (x, y)]
            a, b = (np.unpackbits(s, axis=1) for s in looked_up)
            pairs.append(min((i != j for i in a for j in b), key=np.sum))
        pairs = np.array(pairs)
        assert pairs[:, : near_dedup.COMPARED].sum(axis=1).max() <= near_dedup.MAX_DISTANCE
        for texts in (1_000, 200_000):
            places = near_dedup.segment_places(texts)
            assert places.min() >= near_dedup.COMPARED
            assert np.any([~pairs[:, p].any(axis=1) for p in places], axis=0).all()


def test_parts_are_components_of_close_prints(monkeypatch):
    monkeypatch.setattr(near_dedup, "SOME", 7)
    monkeypatch.setattr(near_dedup, "OTHERS", 11)
    generator = np.random.default_rng(3)
    centers = generator.integers(0, 2, (6, 192))
    bits = [centers[generator.integers(6)] ^ (generator.random(192) < rate) for rate in generator.uniform(0.05, 0.3, 150)]
    prints = np.packbits(np.array([*bits, *generator.integers(0, 2, (40, 192))]), axis=1).view(np.uint64)
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if sum(int(a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= 58 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    found = near_dedup.parts(prints).tolist()
    assert len(set(found)) == len(set(root)) == len(set(zip(found, root, strict=True)))


def test_candidates_share_a_key(spark):
    """Near copies, in one very large bucket among others, and no text alone; small batches cut buckets."""
    generator = np.random.default_rng(4)
    base = random_set(generator, 300)
    sets = [np.unique(np.append(np.delete(base, generator.integers(300, size=8)), random_set(generator, 5))) for _ in range(150)]
    sets += [random_set(generator, 300) for _ in range(100)]
    nodes = spark.createDataFrame([(i, bytearray(near_dedup.fingerprints(s))) for i, s in enumerate(sets)], "node long, print binary").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        rows = near_dedup._buckets(nodes, 100_000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == len({(r.key, r.node) for r in rows}) and {r.node for r in rows} == set(range(150))
    keys = {i: {r.key for r in rows if r.node == i} for i in range(150)}
    assert all(keys[i] & keys[j] for i in range(150) for j in range(i))


def test_eight_words_and_nine(spark):
    """Sets of four and of five shingles, 0.8 alike."""
    generator = random.Random(5)
    texts = []
    for _ in range(300):
        words = ["".join(generator.choice("abcdefgh") for _ in range(6)) for _ in range(9)]
        texts += [" ".join(words), " ".join(words[1:] if generator.random() < 0.5 else words[:-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.keep_one_of_each_group(docs).collect()} == set(range(0, 600, 2))


def crowd_of_texts(generator, n):
    """n texts of one base, most of them apart: each has 15 of 400 words of its own; every fifth is a near copy of the one before."""
    word = lambda: "".join(generator.choice("abcdefgh") for _ in range(7))
    base, texts = [word() for _ in range(400)], []
    for i in range(n):
        own = list(texts[-1] if i % 5 == 4 else base)
        for at in [generator.randrange(400)] if i % 5 == 4 else generator.sample(range(0, 400, 5), 15):
            own[at] = word()
        texts.append(own)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_rows_grow_with_a_crowd_and_not_with_its_square(spark, monkeypatch):
    """Sets that are sent to the homes of others, of one crowd of candidates that are apart but for a few."""
    monkeypatch.setattr(near_dedup, "HOME_SETS", 8)
    sent, alike = [], near_dedup._alike

    def counted(few, rows, *others):
        sent[-1] += few.join(rows.select("key", "home").distinct(), "key").select("home", "a").distinct().count()
        return alike(few, rows, *others)

    monkeypatch.setattr(near_dedup, "_alike", counted)
    for n in (40, 120):
        by_id = crowd_of_texts(random.Random(13), n)
        sent.append(0)
        docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
        kept = {r.doc_id for r in near_dedup.keep_one_of_each_group(docs).collect()}
        assert kept == kept_by_brute_force(by_id) == {i for i in by_id if i % 5 != 4}
    assert 8 <= sent[0] <= 80 and 24 <= sent[1] <= 240, sent


def test_lists_hold_all_similar_pairs_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_CROWD", 4)
    generator = np.random.default_rng(6)
    sets = {}
    for crowd, n in ((0, 60), (100, 4), (200, 25)):
        base = np.arange(crowd * 1000, crowd * 1000 + 50)
        for i in range(n):
            out, own = generator.integers(0, 9), generator.integers(0, 6)
            sets[crowd + i] = {*generator.permutation(base)[out:].tolist(), *generator.integers(10**9, 10**12, own).tolist()}
    sets |= {300 + i: {5, 6, 7, 8, *([9] if i else [])} for i in range(6)}  # sets of four and of five
    crowds = spark.createDataFrame([(i, i // 100 * 100, sum(j // 100 == i // 100 for j in sets)) for i in sets], "node long, crowd long, members long")
    rows = near_dedup._lists(crowds, spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, hashes array<long>"), 0.8).collect()
    assert len(rows) == len({(r.key, r.node) for r in rows})
    keys = {i: {r.key for r in rows if r.node == i} for i in sets}
    similar = [(i, j) for i in sets for j in sets if i < j and i // 100 == j // 100 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(similar) > 100 and all(keys[i] & keys[j] for i, j in similar)
    assert not any(keys[i] & keys[j] for i in sets for j in sets if i // 100 != j // 100)


def test_crowds_are_what_buckets_join(spark):
    generator = random.Random(17)
    pairs = sorted({(generator.randrange(60), generator.randrange(150)) for _ in range(160)} | {(100 + i, 200 + i + j) for i in range(30) for j in (0, 1)})
    root = {node: node for _, node in pairs}
    for _ in root:
        for key in {k for k, _ in pairs}:
            least = min(root[n] for k, n in pairs if k == key)
            root |= {n: least for k, n in pairs if k == key}
    expected = {n: r for n, r in root.items() if list(root.values()).count(r) > 1}
    found = near_dedup._crowds(spark.createDataFrame(pairs, "key long, node long")).collect()
    assert len(found) == len(expected) and {r.node: r.crowd for r in found} == expected
    assert all(r.members == list(root.values()).count(r.crowd) for r in found)
