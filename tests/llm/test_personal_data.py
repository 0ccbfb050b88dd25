"""Personal data: spans and scores against plain Python, and texts with very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from scanloom.llm import pii


def confirmed(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def plain(text):
    found = []
    for kind in pii.KINDS:
        for m in re.finditer(kind.pattern, text):
            start, end = m.span()
            if kind.name == "iban":
                n = pii.IBAN_LENGTHS.get(m[0][:2], 0)
                end = next((start + i for i in range(1, len(m[0]) + 1) if len(m[0][:i].replace(" ", "")) == n and m[0][i - 1] != " "), None)
                if end is None:
                    continue
                part = text[start:end].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in part[4:] + part[:4])) % 97 != 1:
                    continue
            elif not confirmed(kind.name, m[0]):
                continue
            score = kind.score + (pii.CONTEXT_WEIGHT if re.search(kind.context, text[max(0, start - pii.CONTEXT_CHARS) : start].lower()) else 0)
            if score >= kind.least:
                found.append((kind.name, start, end, score))
    return found


def test_against_plain_python(spark):
    parts = ["a.b@c.de", "x@y", "10.0.0.1", "999.1.1.1", "4539 1488 0343 6467", "12", "3-4", "+49 (30) 123-4567", "DE89370400440532013000", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "123-45-6789", "Mail", "SSN", "card", "Phone:", "é", "\n", " ", " ", " ", ",", ","]
    generator = random.Random(2)
    texts = ["".join(generator.choice(parts) for _ in range(generator.randrange(60))) for _ in range(300)]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_time_grows_with_the_matches(spark):
    def seconds(n):
        text = " ".join(f"mail user{i}@host{i % 7}.org" for i in range(n))
        docs, began = spark.createDataFrame([(1, text)], "doc_id long, text string"), time.time()
        spans = F.col("spans")
        row = pii.find_personal_data(docs).select(F.size(spans), spans[n - 1]["end"], spans[n - 1]["score"]).first()
        assert tuple(row) == (n, len(text), 100)
        return time.time() - began

    seconds(1_000)
    few, many = min(seconds(32_000) for _ in range(2)), min(seconds(64_000) for _ in range(2))
    assert many <= 2.5 * few + 1
