"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) follow fixed patterns and checks; such a span stays whatever
its score. The method adds bank accounts (iban, confirmed by mod 97), national ids (ssn) and
phone numbers without a country code (local_phone), which need a score of ACCEPT or more.

Each pattern is run so that its time is in proportion to the text: e-mail addresses are found
from their "@" outwards, dotted and spaced digit chains are taken whole, and an added span is held
against the base spans in one sweep. So very long texts are searched whole. Null texts count as
empty and have no spans. Repeated rows are searched each; other columns are left alone; an empty
table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import ready, table

NAME = "op3_pii"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: A span starts at its kind's weight, wins CONFIRMED for a checksum and NEARBY for a context word within REACH characters.
WEIGHT = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "local_phone": 0.2}
CONFIRMED, NEARBY, ACCEPT, REACH = 0.4, 0.4, 0.6, 50
CONTEXT = {
    "email": ("mail", "contact"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
_NEAR = {k: re.compile(r"(?<![A-Za-z])(?:" + "|".join(v) + r")(?![a-z])", re.I) for k, v in CONTEXT.items()}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            # a later address can take over what stands here, but no local part reaches across an "@"
            done = at + 1
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _SPACED.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield "phone", m.start(), m.end()


def proposals(text: str) -> Iterator[tuple[Span, bool]]:
    """Spans with whether a checksum or range check confirms them."""
    for s in emails(text):
        yield s, True
    for s in ips(text):
        yield s, True
    for s in cards(text):
        yield s, True
    for s in phones(text):
        yield s, True
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield ("iban", m.start(), m.end()), True
    for m in _SSN.finditer(text):
        yield ("ssn", m.start(), m.end()), False
    for m in _LOCAL_PHONE.finditer(text):
        yield ("local_phone", m.start(), m.end()), False


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in stretches:
        if out and lo < out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in the order of start, then kind as listed."""
    found = []
    for (kind, lo, hi), confirmed in proposals(text):
        near = _NEAR[kind].search(text, max(0, lo - REACH), lo) or _NEAR[kind].search(text, hi, min(len(text), hi + REACH))
        score = min(1.0, WEIGHT[kind] + CONFIRMED * confirmed + NEARBY * bool(near))
        if kind in BASE or score >= ACCEPT - 1e-9:
            found.append((kind, lo, hi, score, kind in BASE))
    taken = _merged(sorted((lo, hi) for _, lo, hi, _, b in found if b))
    ends = [hi for _, hi in taken]

    def free(lo: int, hi: int) -> bool:
        k = bisect_right(ends, lo)  # the first stretch that ends behind lo
        return k == len(taken) or taken[k][0] >= hi

    found = [x for x in found if x[4] or free(x[1], x[2])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, spans array<struct<kind, start, end, score, base>>."""
    ready(docs.sparkSession)
    keys = ("kind", "start", "end", "score", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).fill_null("")
            likely = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
            out = [[dict(zip(keys, s, strict=True)) for s in spans(t.as_py())] if yes else [] for t, yes in zip(texts, likely, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, SPANS)], names=["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    rows = find_pii(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
