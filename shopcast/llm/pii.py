"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes
and identifier cues.  From each anchor a local parser expands to the
boundaries of one kind and validates it:

* ``email``, ``ip``, ``card``, ``phone``: leftmost, non-overlapping per kind,
  failing matches dropped without retry;
* ``account``: an identifier after a cue (``iban``, ``account``, ``acct``,
  ``konto``, ``compte``, ``cuenta``, ``ssn``, ``passport``; with ``no``, ``number``,
  ``:``, ``#`` or ``=`` between): 6 to 34 letters and digits, six digits at
  least, ISO 7064 check digits where it looks like an IBAN;
* ``login``: the ``user:password`` part behind a URL scheme in any case.

An address is a host's number (``ip``); a web address has no kind of its own.

Offsets are code points, end exclusive.  Defined results: null texts are empty;
empty texts have no spans; repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The patterns of the kinds, anchored at a start found from an anchor.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|id)\b\.?)?\s?[:#=]?\s?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{0,2}[0-9](?:[-]?[0-9]){5,19})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@:]+(?=@)")
_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")


def cases(word: str) -> set[str]:
    """The word in all mixtures of upper and lower case."""
    return {"".join(c) for c in product(*[{c.lower(), c.upper()} for c in word])}


def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchor strings, with their kind and length."""
    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("cue", {c for w in _CUES for c in (w, w.upper(), w.title())}), ("scheme", {c for w in _SCHEMES for c in cases(w)})):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain and start < at else None


def _account(text: str, end: int) -> tuple[int, int] | None:
    m = _ACCOUNT.match(text, end)
    if not m:
        return None
    plain = m[1].replace(" ", "").replace("-", "")
    looks_iban = plain[:2].isalpha() and len(plain) >= 15
    return m.span(1) if sum(c.isdigit() for c in plain) >= 6 and (not looks_iban or iban(plain)) else None


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans, by kind as in ``KINDS``, then by start."""
    found: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        done[kind] = end
        if valid:
            found[kind].append((kind, start, end))

    for last, (anchor, length) in automaton.iter(text):
        first = last - length + 1
        if anchor == "digit":
            inside = first > 0 and "0" <= text[first - 1] <= "9"   # then the run's start has failed already
            if first >= done["ip"] and not inside and (m := _IP.match(text, first)):
                parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
                take("ip", first, m.end(), all(len(p) <= 3 and int(p) <= 255 for p in parts))
            if first >= done["card"] and (m := _CARD.match(text, first)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", first, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif anchor == "at":
            if first >= done["email"] and (span := _email(text, first, done["email"])):
                take("email", *span)
        elif anchor == "plus":
            if first >= done["phone"] and (m := _PHONE.match(text, first)):
                take("phone", first, m.end(), 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
        elif anchor == "cue":
            if first >= done["account"] and not (first and text[first - 1].isalnum()) and (span := _account(text, last + 1)):
                take("account", *span)
        elif first >= done["login"] and (m := _LOGIN.match(text, last + 1)):
            take("login", *m.span())
    return [span for kind in KINDS for span in found[kind]]


def find(text: Column) -> Column:
    """array of (kind, start, end) of a text column."""
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        automaton = anchors()
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(x.as_py(), automaton)] for x in texts], shape)
    return run(F.coalesce(text, F.lit("")))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text, a row a document."""
    found = docs.select(F.col(doc_id), find(F.col(text)).alias("found"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(doc_id, *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def masked(text: str, automaton: ahocorasick.Automaton) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mark of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans_of(text, automaton), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(text: Column) -> Column:
    """The text column with personal data replaced; null stays null."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        automaton = anchors()
        return pa.array([None if (t := x.as_py()) is None else masked(t, automaton) for x in texts], pa.string())
    return run(text)
