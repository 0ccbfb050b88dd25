"""Secrets: every kind, counts and spans against plain regular expressions, and texts with thousands of matches."""

import hashlib
import random
import re

import pytest

from scanloom.llm import common, secrets
from scanloom.llm.queries import queries

PARTS = [
    "password = hunter22", "API_KEY: 'abc'", "apikey=Zm9vYmFyYmF6", "secret:=", "AKIA" + "A1B2" * 4, "AKIA" + "A1B2" * 3, "0123456789abcdef" * 2, "deadbeef",
    "ghp_" + "a1B2" * 9, "gho_" + "a1B2" * 8, "xoxb-12345-abcdef", "xoxq-12345-abcdef", "sk_live_" + "0aZ9" * 4, "rk_live_" + "0aZ9" * 5, "AIza" + "x-_Y1" * 7, "AIza" + "x-_Y1" * 6,
    "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "eyJhbGci.eyJz.x", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN CERTIFICATE-----", "é", "plain", "\n",
]


def plain(text):
    found = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, m.end()))
    return [(secrets.RULES[k].name, a, b) for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def texts():
    generator = random.Random(8)
    return ["".join(generator.choice(PARTS) + generator.choice((" ", "", ",")) for _ in range(generator.randrange(12))) for _ in range(400)] + [" ".join(PARTS * 300), None, ""]


def test_all_kinds(spark, texts, monkeypatch):
    monkeypatch.setattr(common, "PART_BYTES", 2000)
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    assert found == {i: plain(t or "") for i, t in enumerate(texts)}
    assert {k for x in found.values() for k, _, _ in x} == {r.name for r in secrets.RULES}


def test_query(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    rows = queries()["op8_secrets"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        every = plain(texts[r.doc_id] or "")
        base = [s for s in every if s[0] in secrets.BASE_KINDS]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE_KINDS)
        assert r.spans == join(every) and r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
