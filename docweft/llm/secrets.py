"""Secret scans with multipart credential linking.

Strong findings stand alone: an assignment of a long value to a secret's name, a
key identifier, a long run of hex digits. Weak parts - a bare 40-character key
body, a bare 32- to 44-character base64 value, a service endpoint - are common
in clean text; they are reported only where complementary parts meet: a body
within `scope` characters of an access identifier, an endpoint within `scope`
characters of a body that is linked so or of a strong finding that names a key.
The link is an interval join of the parts' spans, swept in order of position
inside each document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import ship, slices

SCOPE = 400
#: Order of kinds at equal starts; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "body", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BODY = re.compile(r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{32,44}={0,2}(?![A-Za-z0-9+/=_.-])")
ENDPOINT = re.compile(r"(?:https?://|s3://)[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com\b", re.ASCII)
#: A text without any of these has no strong finding, and weak parts need one.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{16}"

Span = tuple[int, int, int]


def strong(text: str) -> list[Span]:
    """(start, kind, end) of each strong finding."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _near(parts: list[Span], others: list[Span], scope: int) -> list[Span]:
    """Interval join: the parts whose gap to some other part is at most `scope`; both lists by start."""
    out, ends, k, far = [], [], 0, -1
    starts = np.array([s for s, _, _ in others], np.int64)
    for s, kind, e in parts:
        while k < len(others) and others[k][0] <= s:
            far = max(far, others[k][2])
            k += 1
        after = int(np.searchsorted(starts, s, side="right"))
        if (far >= 0 and s - far <= scope) or (after < len(others) and others[after][0] - e <= scope):
            out.append((s, kind, e))
    return out


def linked(text: str, found: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts that complementary parts confirm, given the strong findings."""
    identifiers = [x for x in found if x[1] == 1]
    keyed = [x for x in found if x[1] in (0, 1)]
    if not keyed:
        return []
    covered = sorted((s, e) for s, k, e in found if k in (0, 2))
    bodies = [(m.start(), 3, m.end()) for m in BODY.finditer(text) if re.search(r"\d", m[0]) and re.search(r"[A-Za-z]", m[0])] if identifiers else []
    bodies = [b for b in bodies if not any(s <= b[0] and b[2] <= e for s, e in covered)]
    bodies = _near(bodies, identifiers, scope)
    ends = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(bodies + _near(ends, sorted(bodies + keyed), scope))


SCHEMA = "doc_id bigint, kinds array<string>, starts array<int>, ends array<int>, weak array<boolean>"


def find_secrets(docs: DataFrame, scope: int = SCOPE, keep: str = "doc_id") -> DataFrame:
    """One row per document row with its spans, ordered by start and kind.

    Offsets count code points, ends are exclusive. Null counts as empty; rows
    without findings have empty arrays; null ids and repeated rows stay rows of
    their own. Work is linear in the text, row by row: no shuffle, no skew.
    """
    kind = docs.schema[keep].dataType.simpleString()

    def scan(batches):
        for rows, _, _ in slices(batches):
            text = rows.column(rows.schema.get_field_index("text"))
            may = pc.fill_null(pc.match_substring_regex(text, MAYBE), False).to_numpy(zero_copy_only=False)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows.num_rows)]
            for i in np.flatnonzero(may):
                whole = text[int(i)].as_py()
                base = strong(whole)
                found[i] = sorted(base + linked(whole, base, scope)) if base else []
            flat = [x for f in found for x in f]
            bounds = np.zeros(rows.num_rows + 1, np.int32)
            np.cumsum([len(f) for f in found], out=bounds[1:])
            parts = [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32()), pa.array([k > 2 for _, k, _ in flat], pa.bool_())]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(keep)), *(pa.ListArray.from_arrays(pa.array(bounds), p) for p in parts)], names=[keep, "kinds", "starts", "ends", "weak"])

    return docs.select(keep, "text").mapInArrow(scan, f"{keep} {kind}, kinds array<string>, starts array<int>, ends array<int>, weak array<boolean>")


ship(__name__)
