"""Secret scan: patterns that stand alone, and multipart credentials linked by interval joins."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import map_rows, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so shorter runs fail either way

# Parts that mean nothing alone; each is reported only near its complements.
WEAK = {
    "id": re.compile(r"""\b(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A),
    "key": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"\b(?:https?|ftp|jdbc:[a-z]{2,}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]{3,}(?::[0-9]+)?", re.A),
}
# What completes a part: base findings count as identifiers (access) and secrets (assign, hex).
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "id"), ("assign", "hex", "key"), ("endpoint",)
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Findings that stand alone, by kind, in code points."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _scopes(text: str, starts: np.ndarray) -> np.ndarray:
    """The scope of each position: paragraphs, which blank lines divide."""
    return np.searchsorted(np.array([m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)], np.int64), starts, "right")


def _near(left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """Interval join of (scope, start, end) rows in order of start: which left rows have a right row within reach.

    Two binary searches per row on (scope, position); no pair is formed.
    """
    if not len(left) or not len(right):
        return np.zeros(len(left), bool)
    far = np.int64(1) << 40
    keys = np.sort(right[:, 0] * far + right[:, 1])
    low = np.searchsorted(keys, left[:, 0] * far + np.maximum(left[:, 1] - reach, 0), "left")
    high = np.searchsorted(keys, left[:, 0] * far + left[:, 2] + reach, "right")
    return high > low


def linked_spans(text: str, base: dict[str, list[tuple[int, int]]], reach: int) -> list[tuple[int, str, int]]:
    """Weak parts with their complements in the same scope and within ``reach`` code points, as (start, kind, end).

    An identifier needs a secret; a loose secret needs an identifier; an endpoint needs both. Parts inside a base
    finding are that finding's and are not reported again.
    """
    found = dict(base)
    taken = sorted(s for spans in base.values() for s in spans)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else np.zeros(0, np.int64)
    begins = np.array([s for s, _ in taken], np.int64)
    for kind, pattern in WEAK.items():
        spans = [m.span() for m in pattern.finditer(text)]
        if spans and taken:
            before = np.searchsorted(begins, [e for _, e in spans], "left")
            spans = [s for s, n in zip(spans, before) if not n or ends[n - 1] <= s[0]]
        found[kind] = spans
    if not any(found[k] for k in WEAK):
        return []
    rows = {}
    for kind, spans in found.items():
        at = np.array(spans, np.int64).reshape(-1, 2)
        rows[kind] = np.column_stack([_scopes(text, at[:, 0]), at])
    join = lambda kinds: np.concatenate([rows[k] for k in kinds])
    ids, secrets = join(IDENTIFIERS), join(SECRETS)
    good = {
        "id": _near(rows["id"], secrets, reach),
        "key": _near(rows["key"], ids, reach),
        "endpoint": _near(rows["endpoint"], ids, reach) & _near(rows["endpoint"], secrets, reach),
    }
    return [(int(s), kind, int(e)) for kind, ok in good.items() for _, s, e in rows[kind][ok]]


def listed(spans: list[tuple[int, str, int]]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan_secrets(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.

    Base findings are assignments with a value of at least 8 characters, access identifiers of at least 16 and
    lower-case hexadecimal runs of at least 32. Around them, identifiers, loose secrets and endpoints are joined by
    position within a paragraph; a weak part is reported only where its complements co-occur within ``reach`` code
    points. Scopes lie inside one text, so the join runs where the text is: no shuffle, memory bounded by one batch
    and its findings, time linear in the text (each row does two binary searches).

    Defined cases: null counts as empty; nothing found gives zero counts, the hash of the empty string and empty spans;
    equal rows give equal results; columns of the same names are replaced; an empty table gives no rows.
    """
    def scan(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in texts_of(batch, text):
            base = base_spans(t)
            flat = [(s, k, e) for k, spans in base.items() for s, e in spans]
            for k, spans in base.items():
                out[f"n_{k}"].append(len(spans))
            out["base_sha256"].append(hashlib.sha256(listed(flat).encode()).hexdigest())
            out["spans"].append(listed(flat + linked_spans(t, base, reach)))
        return {k: pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items()}

    return map_rows(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", scan)
