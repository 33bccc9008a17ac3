"""Secret scans with multipart credential linking.

Base detectors find assignments, access identifiers and long hexadecimal runs.
Beyond them the scan looks for the parts of a credential: weak identifiers, weak
secrets and endpoints. Each part gets a scope, the stretch of REACH bytes on either
side that doesn't leave its paragraph. A scope meets each part that overlaps it. An interval join of identifiers,
secrets and endpoints by scope then links parts, and a weak part is reported only
when it has a complementary one: an identifier a secret, a secret an identifier or
an endpoint, an endpoint a secret. Base spans are always reported.

The join sorts the parts of a text and looks up neighbours by bisection, so it never
lists pairs. The scan is a map over rows: nothing is shuffled.

Defined results: a null text counts as empty and has no spans. Rows map one to one,
repeated ones too, and an empty table gives none. Long texts are scanned whole. Spans
that start together stand in the order of their kinds. Other columns pass through
`redact` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from glosswright.llm._common import arrow_map, bounded_batches, utf8

#: Bytes of UTF-8 between linked parts at most.
REACH = 400

# The patterns of the base detectors, on UTF-8 with A-Z lower-cased for the first.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

#: Weak parts, on text with A-Z lower-cased; group 1 is the part.
WEAK_ID = re.compile(rb"""(?:user(?:name)?|login|client_?id|access_?(?:key_?)?id|account)["']?\x20*[:=]\x20*["']?([a-z0-9@._-]{3,})""")
WEAK_SECRET = re.compile(rb"""(?:pass|pwd|credential|auth|private_?key|signature|key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]{8,})""")
ENDPOINT = re.compile(rb"""((?:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[a-z0-9._~:/?#@!$&*+,;=%-]{4,})""")

#: An assignment and a hexadecimal run are secrets, an access id is an identifier.
ROLE = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}
WANTED = {3: ("secret",), 4: ("id", "endpoint"), 5: ("secret",)}

_PARAGRAPH = re.compile(rb"\n[\x20\t]*\n")
_ASSIGN_GATE = re.compile(rb"passw|secret|token|api_?key")
_WEAK_GATE = re.compile(rb"://|[:=]")


def base_spans(text: bytes, lower: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the base detectors."""
    lower = text.lower() if lower is None else lower
    found = []
    if _ASSIGN_GATE.search(lower):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(lower) if m.end(1) - m.start(1) >= 6]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return found


def weak_parts(lower: bytes) -> list[tuple[int, int, int]]:
    """All weak parts, also those that a base span touches."""
    if not _WEAK_GATE.search(lower):
        return []
    return [(*m.span(1), kind) for kind, rx in ((3, WEAK_ID), (4, WEAK_SECRET), (5, ENDPOINT)) for m in rx.finditer(lower)]


def untouched(weak: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that no base span touches."""
    taken = sorted(base)
    starts = [s for s, _, _ in taken]
    ends: list[int] = []
    for _, e, _ in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    return [w for w in weak if not (i := bisect_left(starts, w[1])) or ends[i - 1] <= w[0]]


def linked(parts: list[tuple[int, int, int]], paragraphs: list[int], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak parts in whose scope a complementary part starts.

    paragraphs: the sorted starts of paragraphs.
    """
    of: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": []}
    for start, end, kind in sorted(parts):
        of[ROLE[kind]].append((start, end))
    out = []
    for start, end, kind in parts:
        if kind < 3:
            continue
        at = bisect_right(paragraphs, start)
        low = max(start - reach, paragraphs[at - 1] if at else 0)
        high = min(end + reach, paragraphs[at] if at < len(paragraphs) else end + reach)
        for other in WANTED[kind]:
            # the part's own role is never among the wanted ones
            i = bisect_left(of[other], (low,))
            if i < len(of[other]) and of[other][i][0] < high:
                out.append((start, end, kind))
                break
    return out


def overtaken(parts: list[tuple[int, int, int]], paragraphs: list[int], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak parts in whose scope a complementary part ends that starts before it."""
    of: dict[str, tuple[list[int], list[int]]] = {"id": ([], []), "secret": ([], []), "endpoint": ([], [])}
    for start, end, kind in sorted(parts):
        starts, ends = of[ROLE[kind]]
        starts.append(start)
        ends.append(max(end, ends[-1] if ends else 0))
    out = []
    for start, end, kind in parts:
        if kind < 3:
            continue
        at = bisect_right(paragraphs, start)
        low = max(start - reach, paragraphs[at - 1] if at else 0)
        for other in WANTED[kind]:
            starts, ends = of[other]
            i = bisect_left(starts, low)
            if i and ends[i - 1] > low:
                out.append((start, end, kind))
                break
    return out


def scan(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points by start, then kind."""
    lower = text.lower()
    base = base_spans(text, lower)
    weak = weak_parts(lower)
    if weak:
        parts, paragraphs = [*base, *weak], [m.end() for m in _PARAGRAPH.finditer(text)]
        met = {*linked(parts, paragraphs), *overtaken(parts, paragraphs)}
        weak = [w for w in untouched(weak, base) if w in met]
    found = [*base, *weak]
    if found and not text.isascii():
        points, last, at = {}, 0, 0
        for x in sorted({x for s, e, _ in found for x in (s, e)}):
            at += len(text[last:x].decode())
            points[x], last = at, x
        found = [(points[s], points[e], k) for s, e, k in found]
    return sorted(found, key=lambda f: (f[0], f[2], f[1]))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans for each row, see the module's head."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = [scan(t) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            **{f"n_{KINDS[k]}": [sum(x[2] == k for x in f) for f in found] for k in range(len(KINDS))},
            "base_sha256": [hashlib.sha256(_joined([x for x in f if x[2] < 3]).encode()).hexdigest() for f in found],
            "spans": [_joined(f) for f in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return arrow_map(
        docs.select("doc_id", utf8().alias("text")), run, f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span, endpoints aside, replaced by mask; columns as before."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for t in batch.column(at).to_pylist():
                last, out = 0, []
                for s, e, k in scan(t.encode()) if t else ():
                    if k != 5 and s >= last:
                        out += [t[last:s], mask]
                        last = e
                texts.append(t if t is None else "".join([*out, t[last:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
