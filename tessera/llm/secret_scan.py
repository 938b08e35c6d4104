"""Secret scan with multipart credential linking.

Strong (base) findings: assignments, AKIA access keys and long hexadecimal runs. Weak candidates - named
identifiers, high-entropy tokens and endpoints - are interval-joined within scopes (same paragraph, at most
`reach` code points apart) and reported only where complementary parts co-occur:
  link_id        a named identifier with a secret in scope
  link_secret    a high-entropy token with an access identifier in scope
  link_endpoint  an endpoint with both an access identifier and a secret in scope
The join is a sorted sweep per kind (bisection over starts and over the running maximum of ends), which never forms
pairs.

Edge cases: null text counts as empty and gives no span; null ids pass through; repeated rows are scanned
each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(
    r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[^\s"'<>]{4,}""", re.IGNORECASE | re.ASCII)
BREAK = re.compile(r"\n[\x20\t\r]*\n")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong findings, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class _Parts:
    """Intervals of one role, sorted; tells whether any lies within reach of another, in the same scope."""

    def __init__(self, spans: list[tuple[int, int]], scope_of):
        self.spans = sorted(set(spans))
        self.starts = [a for a, _ in self.spans]
        self.tops: list[int] = []  # the furthest end so far, so a long span does not widen every lookup
        for _, b in self.spans:
            self.tops.append(max(b, self.tops[-1] if self.tops else 0))
        self.scope_of = scope_of

    def near(self, a: int, b: int, reach: int) -> bool:
        i = bisect_left(self.tops, a - reach)
        scope = self.scope_of(a)
        while i < len(self.spans) and self.starts[i] <= b + reach:
            x, y = self.spans[i]
            if y >= a - reach and (y <= a or x >= b) and self.scope_of(x) == scope:
                return True
            i += 1
        return False


def link(text: str, base: list[tuple[int, int, int]], reach: int = 200) -> list[tuple[int, int, int]]:
    """The weak candidates that complementary parts confirm, as (start, kind, end)."""
    taken = sorted((a, b) for a, _, b in base)
    firsts = [a for a, _ in taken]
    tops: list[int] = []
    for _, b in taken:
        tops.append(max(b, tops[-1] if tops else 0))

    def free(a: int, b: int) -> bool:
        i = bisect_left(firsts, b)
        return i == 0 or tops[i - 1] <= a

    weak_ids = [(m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    weak_ids = [x for x in weak_ids if free(*x)]
    ids = [(a, b) for a, k, b in base if k == 1] + weak_ids
    if not ids:
        return []  # every rule needs an access identifier in scope
    breaks = [m.start() for m in BREAK.finditer(text)]
    scope_of = lambda at: bisect_left(breaks, at)
    inside = _Parts(weak_ids, scope_of)
    weak_secrets = []
    for m in WEAK_SECRET.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.5 and "AKIA" not in s:
            a, b = m.span()
            j = bisect_left(inside.starts, b)
            if free(a, b) and (j == 0 or inside.spans[j - 1][1] <= a):
                weak_secrets.append((a, b))
    id_parts = _Parts(ids, scope_of)
    weak_secrets = [x for x in weak_secrets if id_parts.near(*x, reach)]
    secrets = _Parts([(a, b) for a, k, b in base if k != 1] + weak_secrets, scope_of)
    out = [(a, 3, b) for a, b in weak_ids if secrets.near(a, b, reach)]
    out += [(a, 4, b) for a, b in weak_secrets]
    for m in ENDPOINT.finditer(text):
        a, b = m.span()
        if free(a, b) and id_parts.near(a, b, reach) and secrets.near(a, b, reach):
            out.append((a, 5, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end, value>> by start and then kind, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                rows.append(
                    [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in sorted(base + link(text, base, reach))]
                )
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """The query's columns, from scan()."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"),
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
