"""Personal data against the plain patterns, and the spans that the method adds."""

import hashlib
import re

from pyspark.sql import functions as F

from staytide.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(text):
    out = []
    for n, (kind, regex) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in regex.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), n, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


CASES = [
    None,
    "",
    "mail a.b@c.de, x@y and p@q.r._s@t.u ü😀 z@z.zz",
    "a@b.com._x@c.d a@@b.c @a.b a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3 999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111  1111",
    "+1 (212) 555-0100. +49 30 1234567 +1 2 +123456789012345678 ++1 555 555 5555 +",
    "😀😀 +1 (212) 555-0100 😀 a@b.cd",
    "1" * 5000 + " " + "a" * 5000 + "@" + "b." * 5000,
    "+1" + " " * 5000,
]


def test_base_spans_follow_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = pii.find_spans(df).select("doc_id", pii.spans_text("p_base").alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: brute(t) for i, t in enumerate(CASES)}


def test_whole_table(spark, sf):
    from staytide.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_pii"](spark, sf).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_email == base.count("email")


def test_added_spans_need_checksum_or_context(spark):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 now",
        "pay to DE89 3704 0044 0532 0130 01 now",
        "my SSN is 123-45-6789 ok",
        "part 123-45-6789 ok",
        'token = "b02a37d6319ba0a76482777724d5412c" x',
        "call (212) 555-0100 now",
        "code (212) 555-0100 now",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(df).select("doc_id", pii.spans_text("p_spans").alias("s"), pii.redacted().alias("t")).collect()}
    assert got[0].s.startswith("iban:7:") and got[1].s == ""
    assert got[2].t == "my SSN is [SSN] ok" and got[3].s == ""
    assert got[4].t == 'token = "[SECRET]" x'
    assert got[5].s.startswith("local_phone") and got[6].s == ""


def test_iban_before_capitals_and_numbers(spark):
    cases = {
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF": "[IBAN] BIC COBADEFF",
        "IBAN: DE89 3704 0044 0532 0130 00 BIC: COBADEFF": "IBAN: [IBAN] BIC: COBADEFF",
        "GB82 WEST 1234 5698 7654 32 EUR 500": "[IBAN] EUR 500",
        "DE89370400440532013000 GB82WEST12345698765432": "[IBAN] [IBAN]",
        "NO93 8601 1117 947 12 A": "[IBAN] 12 A",
        "RE12 ABCD EFGH 1234 DE89 3704 0044 0532 0130 00 X": "RE12 ABCD EFGH 1234 [IBAN] X",
        "DE89 3704 0044 0532 0130 01 BIC COBADEFF": "DE89 3704 0044 0532 0130 01 BIC COBADEFF",
        "DE89 3704 0044 0532 0130 001": "DE89 3704 0044 0532 0130 001",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.find_spans(df).select("doc_id", pii.redacted().alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_redaction_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b@c.de f", "x"), (None, None, None)], "doc_id long, text string, spans string")
    got = pii.find_spans(df).select("doc_id", "spans", pii.redacted().alias("t")).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [tuple(r) for r in got] == [(1, "x", "a [EMAIL] f"), (None, None, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_spans(df).count() == 0


def test_many_matches_take_time_in_proportion(spark):
    """25,000 addresses in a text, and as many mails: found and redacted in order."""
    import time

    texts = [("1.1.1.1 " * 25_000).strip(), "a@b.cd " * 25_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pii.find_spans(df.limit(0)).collect()
    began = time.time()
    got = {r.doc_id: r for r in pii.find_spans(df).select("doc_id", pii.spans_text("p_base").alias("s"), pii.redacted().alias("clean")).collect()}
    assert time.time() - began < 15
    assert {i: r.s for i, r in got.items()} == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0].clean == ("[IP] " * 25_000).strip() and got[1].clean == "[EMAIL] " * 25_000
