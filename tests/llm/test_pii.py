import hashlib
import re
import time
from collections import Counter

import numpy as np

from llm_fixtures import documents, no_documents, odd_documents  # noqa: F401

from cellweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * n, 10)) for n in d[1::2])) % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def expected(text):
    found = base(text or "")
    named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
    return (*[sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(named.encode()).hexdigest())


def held(docs):
    schema = ", ".join(f"n_{k} long" for k in pii.KINDS)
    rows = pii.detect(docs).mapInArrow(pii.digest, f"doc_id long, {schema}, base_sha256 string, spans string, n_added long").collect()
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    assert got == Counter((r.doc_id, *expected(r.text)) for r in docs.select("doc_id", "text").collect())
    return {r.doc_id: r for r in rows}


def test_base_spans_match_brute_force(documents):
    held(documents)


TEXTS = ["a@b.c%d@e.f x@y @z.w q@-.-", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.02.3.0004 1.2.3.a 4.5.6.7", "4111 1111 1111 1111, 4111-1111-1111-1112 0000 0000 0000",
         "+1 (375) 555-4393 +12 34 +1-2-3-4-5-6-7-8-9 ++4912345678 +1 5555 6666 7777 8888 9", "é😀 mail: a.b@c.de. 😀 12345678901234567890123 +49",
         "call (555) 234-5678 or 555-234-5678, SSN 123-45-6789, IBAN DE89370400440532013000, me [at] example [dot] com"]


def test_tricky_texts(spark, odd_documents, no_documents):
    held(odd_documents)
    assert held(no_documents) == {}
    got = held(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert len(got) == len(TEXTS)


def test_long_runs_are_linear():
    start = time.time()
    for text in ("a" * 200000 + " @", "1" * 200000, "+1" + "-" * 200000, "1-" * 100000, "a@" * 50000, "1." * 100000):
        pii.proposals(text)
    assert time.time() - start < 10


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.4
    right = (0.95, 0.9, 0.8, 0.7, 0.6)
    votes = np.array([np.where(rng.random(20000) < r, truth, ~truth) for r in right]).T
    patterns = Counter("".join("np"[int(v)] for v in row) for row in votes)
    chance, prior, _ = pii.reliabilities(sorted(patterns.items()))
    assert abs(prior - 0.4) < 0.03
    for k, r in enumerate(right):
        assert abs(chance[1, k, 2] - r) < 0.04 and abs(chance[0, k, 0] - r) < 0.04


def test_classifier_adds_spans(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (555) 234-56{i % 90 + 10}") for i in range(50)]
    rows += [(100, "call (555) 234-5678 now"), (101, "version 999-00-0000 of order 300.400.500.600")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "local_phone" in got[100] and got[101] == []
