"""PII by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate.

The automaton's cues are the at-sign, digits, schemes and identifier words. From
a cue, a parser that looks at nothing but the text around it finds the borders:

* email: the local part left of an at-sign and the dotted domain right of it;
* ip, card, phone: the maximal run of ``[0-9+().\\x20-]`` around a digit is the only
  place where they can lie, and each kind is read there, left to right;
* url: scheme, ``://`` and what follows up to white space or a quote;
* secret, account: an identifier word (password, token, api key, iban, account, ssn and
  so on) in any case, a separator, and a value with a digit in it;
* key: the fixed beginnings of public kinds of access keys, and their letters and digits; a
  private key's first line.

The base kinds equal the leftmost non-overlapping matches of their expressions over
the whole text. Spans are in code points, the end exclusive, ordered by start and then by
the order of ``KINDS``.

Each parser reads a character a bounded number of times, so a text costs time in proportion to its length, whatever it holds.

Defined results: a null or empty text has no spans; each row gives one row, so equal
rows and ids stay; a very long text is read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account", "key")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # the base matches are the fours of its parts, from the left
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REST = re.compile(r"[^0-9+().\x20-]")
URL = re.compile(r"://[^\s\"'<>]+")
VALUE = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9+/_.-]*[0-9][A-Za-z0-9+/_.-]*)")
NUMBER = re.compile(r"[\s:#=.]{1,4}([A-Z]{0,2}[0-9][0-9A-Z]*(?:[\x20-][0-9A-Z]*[0-9][0-9A-Z]*)*)")
#: fixed identifier words
SECRETS = ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey", "access_key")
ACCOUNTS = ("iban", "account", "acct", "ssn", "passport")
SCHEMES = ("http", "https", "ftp")
#: fixed beginnings of access keys, and the least number of letters and digits that follow
KEYS = {"AKIA": 16, "ASIA": 16, "ghp_": 30, "gho_": 30, "github_pat_": 30, "glpat-": 20, "sk-": 20, "sk_live_": 16, "xoxb-": 20, "xoxp-": 20, "AIza": 30, "-----BEGIN ": 0}
KEY_REST = re.compile(r"[A-Za-z0-9_-]*+")
PEM = re.compile(r"[A-Z ]{0,40}PRIVATE KEY-----")
RUN = frozenset("0123456789+(). -")
CASE = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("secret", SECRETS), ("account", ACCOUNTS), ("key", KEYS)):
        for w in cues:
            a.add_word(w.lower(), (kind, len(w)))
    a.make_automaton()
    return a


def lower(text: str) -> str:
    """A-Z lower-cased; other characters as they are where lower case would move them."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(CASE)


def _number_run(text: str, i: int) -> tuple[int, int]:
    """The maximal run of phone and card characters around position i."""
    lo = i
    while lo and text[lo - 1] in RUN:
        lo -= 1
    m = REST.search(text, i)
    return lo, m.start() if m else len(text)


def _numbers(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    part = text[lo:hi]
    if part.count(".") >= 3:
        for m in DOTTED.finditer(part):
            numbers, at = m[0].split("."), lo + m.start()
            for k in range(0, len(numbers) - 3, 4):
                four = numbers[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(x := n.lstrip("0")) <= 3 and int(x or "0") <= 255 for n in four):
                    yield at, 1, end
                at = end + 1
    if hi - lo >= 9:
        for m in CARD.finditer(part):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                yield lo + m.start(), 2, lo + m.end()
        if "+" in part:
            for m in PHONE.finditer(part):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    yield lo + m.start(), 3, lo + m.end()


def find(text: str | None, cues: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, index of the kind, end) of a text, in order."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    digits_to = email_to = url_to = secret_to = account_to = key_to = 0
    for at, (cue, size) in cues.iter(lower(text)):
        if cue == "digit":
            if at >= digits_to:
                lo, digits_to = _number_run(text, at)
                out.extend(_numbers(text, lo, digits_to))
        elif cue == "at":
            lo = at
            while lo > email_to and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at and (m := DOMAIN.match(text, at)):
                email_to = m.end()
                out.append((lo, 0, email_to))
        elif cue == "scheme":
            lo = at - size + 1
            name = next((s for s in sorted(SCHEMES, key=len, reverse=True) if text[max(0, lo - len(s)) : lo].lower() == s), None)
            if name and lo >= url_to and (m := URL.match(text, lo)):
                url_to = m.end()
                out.append((lo - len(name), 4, url_to))
        elif cue == "secret":
            if at >= secret_to and (m := VALUE.match(text, at + 1)):
                secret_to = m.end(1)
                out.append((m.start(1), 5, secret_to))
        elif cue == "key":
            lo = at - size + 1
            name = text[lo : at + 1]
            if name in KEYS and lo >= key_to and not (lo and text[lo - 1].isalnum()):
                m = PEM.match(text, at + 1) if name.startswith("-") else KEY_REST.match(text, at + 1)
                if m and len(m[0]) >= KEYS[name]:
                    key_to = m.end()
                    out.append((lo, 7, key_to))
        elif at >= account_to and (m := NUMBER.match(text, at + 1)):
            account_to = m.end(1)
            out.append((m.start(1), 6, account_to))
    return sorted(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = automaton()
    for big in batches:
        for b in (big.slice(i, 512) for i in range(0, big.num_rows, 512)):
            found = [find(t, cues) for t in b.column(1).to_pylist()]
            spans = pa.array([[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), spans], ["id", "spans"])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of struct<kind, start, stop>, of each row."""
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(_rows, f"id {kind}, spans array<struct<kind:string,start:long,stop:long>>").withColumnRenamed("id", id_col)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = stop
    return "".join([*out, text[at:]])


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, all spans as text, and the number of all but addresses of pages."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return spans.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
        F.size(F.filter("spans", lambda x: x["kind"] != "url")).cast("long").alias("n_private"),
    )


def base_digest(text: str | None) -> str:
    """The digest of one text, for use outside Spark."""
    spans = [(s, k, e) for s, k, e in find(text, automaton()) if k < len(BASE)]
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
