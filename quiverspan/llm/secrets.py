"""Secret scans by multipart credential linking: weak parts count only beside their complements."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, table

# The patterns of the base kinds, over bytes (assign over lower-cased ones, whose spans are the same).
ASSIGN = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)"
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{16,}"
ASSIGN_MIN, ACCESS_MIN = 12, 18
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

# Weak parts, over lower-cased bytes but for the last.
WEAK_ID = rb"(?:access_?key_?id|client_?id|user_?name|user|login|account)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9_.@-]{3,})"
WEAK_SECRET = rb"(?:password|passwd|pwd|secret|token|api_?key|passphrase|credential)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=!@#%^&*-]{6,})"
ENDPOINT = rb"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]{4,}|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9_.:-]{4,}"
TOKEN = rb"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}"

#: A scope is a paragraph: blank lines end it. Parts are linked anywhere in their scope, unless a gap in bytes is given.
SCOPE, MAX_GAP = rb"\n[\x20\t\r]*\n", None
SPANS = "array<struct<kind:string,start:long,end:long>>"

_assign, _access, _hex, _weak_id, _weak_secret, _endpoint, _token, _scope = map(re.compile, (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT, TOKEN, SCOPE))

Span = tuple[int, int, str]


def base_spans(raw: bytes, low: bytes) -> list[Span]:
    found: list[Span] = []
    if any(word in low for word in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(*m.span(), "assign") for m in _assign.finditer(low) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in _access.finditer(raw) if m.end() - m.start() >= ACCESS_MIN]
    return found + [(*m.span(), "hex") for m in _hex.finditer(raw)]


def _mixed(token: bytes) -> bool:
    return bool(re.search(rb"[A-Z]", token) and re.search(rb"[a-z]", token) and re.search(rb"[0-9]", token))


class Near:
    """Intervals with their scopes, sorted, for interval joins by binary search: linear in the parts, no pairs."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.by: dict[int, tuple[list[int], list[int]]] = {}
        for scope, start, end in sorted(spans):
            starts, ends = self.by.setdefault(scope, ([], []))
            starts.append(start)
            ends.append(max(end, ends[-1] if ends else 0))

    def touches(self, scope: int, start: int, end: int, gap: int) -> bool:
        starts, ends = self.by.get(scope, ([], []))
        last = bisect_right(starts, end + gap) - 1
        return last >= 0 and ends[last] >= start - gap


def linked_spans(raw: bytes, low: bytes, base: list[Span], max_gap: int | None = MAX_GAP) -> list[Span]:
    """The weak parts with a complement in their scope (and within max_gap, if given): an identifier beside a secret, a secret beside
    an identifier or an endpoint, an endpoint beside a secret. Base spans are complements too."""
    ids = [(*m.span(), "weak_id") for m in _weak_id.finditer(low)] if b"=" in low or b":" in low else []
    secrets = [(*m.span(), "weak_secret") for m in _weak_secret.finditer(low)] if b"=" in low or b":" in low else []
    secrets += [(*m.span(), "weak_secret") for m in _token.finditer(raw) if _mixed(m[0])]
    ends = [(*m.span(), "endpoint") for m in _endpoint.finditer(low)] if b"=" in low or b":" in low else []
    if not ids and not secrets and not ends:
        return []
    breaks = [m.end() for m in _scope.finditer(raw)]
    gap = len(raw) if max_gap is None else max_gap
    placed = lambda spans: [(bisect_right(breaks, s), s, e) for s, e, _ in spans]
    taken = Near([(0, s, e) for s, e, _ in base])
    free = lambda spans: [x for x in spans if not taken.touches(0, x[0] + 1, x[1] - 1, 0)]
    near_id = Near(placed([*ids, *(x for x in base if x[2] == "access")]))  # also the ids that a base span reports
    ids, secrets, ends = free(ids), free(secrets), free(ends)
    near_secret = Near(placed([*secrets, *(x for x in base if x[2] != "access")]))
    near_end = Near(placed(ends))
    at = lambda x: (bisect_right(breaks, x[0]), x[0], x[1], gap)
    found = [x for x in ids if near_secret.touches(*at(x))] + [x for x in secrets if near_id.touches(*at(x)) or near_end.touches(*at(x))]
    return found + [x for x in ends if near_secret.touches(*at(x))]


def spans_of(text: str | None, max_gap: int | None = MAX_GAP) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive. Null or empty text: none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    base = base_spans(raw, low)
    found = base + linked_spans(raw, low, base, max_gap)
    if not found:
        return []
    if len(raw) == len(text):
        points = None
    else:  # bytes to code points, walking once
        points, at, n = {}, 0, 0
        for p in sorted({x for s, e, _ in found for x in (s, e)}):
            n += sum((b & 0xC0) != 0x80 for b in raw[at:p]) if p - at < 64 else len(raw[at:p].decode("utf-8", "surrogatepass"))
            points[p], at = n, p
    out = [(kind, points[s] if points else s, points[e] if points else e) for s, e, kind in set(found)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int | None = MAX_GAP) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row; other columns are ignored, repeated rows scanned each for itself.

    One pass without a shuffle: all parts of a credential lie in one text, so the interval join runs inside the row by
    binary search over sorted intervals. A very long text takes time and memory in proportion to its length."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, max_gap)] for t in b["text"]]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def redact(text: str | None) -> str | None:
    """The text with [KIND] for each secret or identifier; overlapping spans become one. Endpoints stay."""
    spans = [x for x in spans_of(text) if x[0] != "endpoint"]
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets blanked in place and the length brought up to date; every row and column stays, repeated rows
    too. A null text stays null, and so does its length; an empty one stays empty; empty table: no rows."""
    out = docs.withColumn(text_col, arrow_column(F.col(text_col), lambda: redact, "string", pa.string()))
    if n_chars_col and n_chars_col in docs.columns:
        changed = F.char_length(F.col(text_col)).cast(docs.schema[n_chars_col].dataType)
        out = out.withColumn(n_chars_col, F.when(F.col(text_col).isNull(), F.col(n_chars_col)).otherwise(changed))
    return out


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """find_secrets over documents, with counts and a digest of the base kinds."""
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_linked"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
