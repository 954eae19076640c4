"""Spans against plain regular expressions, extra kinds, masking and edge rows."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopcast.llm import pii

AUTO = pii.anchors()
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(len(p) < 4000 and int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PART = st.sampled_from(["a", "b.c", "@", ".", "..", "1", "23", "255", "256", "0", "007", "+", " ", "-", "(", ")", "é", "４", "x@y.z", "1.2.3.4",
                        "4539578763621486", "4539 5787 6362 1486", "+1 (555) 555-0100", "%", "_", "\n", "IBAN ", "https://"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.spans_of(text, AUTO) if s[0] in BASE] == plain(text)


def test_extra_kinds():
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.spans_of(t, AUTO) if k not in BASE]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 ok") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN DE89 3704 0044 0532 0130 01 bad") == []
    assert found("account no. 12345678, konto 12") == [("account", "12345678")]
    assert found("see https://joe:pw1@host.example/x and https://host/x") == [("login", "joe:pw1")]
    assert found("The account of 1234567 days") == [] and found("miniban 12345678") == []


def test_schemes_in_any_case():
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.spans_of(t, AUTO)]
    for scheme in ("HTTP://", "Https://", "fTP://", "SFTP://", "ssh://"):
        assert ("login", "joe:pw1") in found(f"see {scheme}joe:pw1@host.example/x")
    assert found("mailto:a.b@c.de") == [("email", "a.b@c.de")] and found("tel:+14565552186")[0] == ("phone", "+14565552186")


def test_report_and_mask(spark):
    rows = [(1, "mail é a.b@c.de, ip 10.0.0.1 and 300.1.1.1"), (2, None), (3, ""), (4, "plain text stays"), (4, "plain text stays"),
            (5, "x" * 300000 + " +1 (456) 555-2186"), (None, "4539578763621486")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert got[1]["spans"] == "email:7:15,ip:20:28" and got[1]["n_email"] == 1 and got[1]["n_ip"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert got[2]["base_sha256"] == got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["n_phone"] == 1
    assert pii.report(docs).count() == 7 and pii.report(docs.limit(0)).count() == 0
    masked = {r["doc_id"]: r["m"] for r in docs.select("doc_id", pii.mask(F.col("text")).alias("m")).collect()}
    assert masked[1] == "mail é [EMAIL], ip [IP] and 300.1.1.1" and masked[2] is None and masked[4] == "plain text stays"
    assert masked[None] == "[CARD]" and masked[5].endswith("x [PHONE]")
