"""Secret scans with multipart credential linking.

Base spans (assign, access, hex) are found by their patterns in whole texts.
Three weaker kinds are kept only as parts of a credential: a ``login`` (a user
or client name assigned by key), a ``secret`` candidate (a mixed token of 32
characters or more) and an ``endpoint`` (a URL with a host, or a host with a
port).  A scope is the stretch of ``reach`` characters around a span, within
its paragraph block (text between blank lines).  Identifiers are access spans
and logins; secrets are assignments, hex spans and candidates.  The interval
join by overlapping scopes reports a login only if an assignment or hex span is
in scope, a secret candidate only if an access identifier is, and an endpoint
only if an identifier and a secret are, which must be spans apart: an
assignment of an access identifier is no secret, and one lone assignment no
credential.  Positions are code points, ends exclusive.

The join is a sorted sweep within each text: a part looks up the nearest
complementary starts, so a text with many parts costs n log n, and no pairs
are listed.  Patterns start once in a run of their characters and do not back
up, so that scanning is linear in the text.  Texts are scanned whole, one row at a time, without a shuffle.

Nulls are empty texts, and empty texts have no spans.  Repeated rows get equal
results, empty tables empty ones; every further column goes along, and columns
of the input named like the result's (spans, n_assign, n_access, n_hex,
base_sha256, n_login, n_secret, n_endpoint) are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 240
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])")  # a key name and = may stand before
LOGIN = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}+""", re.I | re.A)
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]++(?::[0-9]{1,5})?(?:/[^\s\"'<>]*+)?|(?<![\w.-])([a-z0-9.-]++):[0-9]{2,5}\b")
HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,}")
BLANK = re.compile(r"\n[ \t]*\n")
BASE = ("assign", "access", "hex")
WEAK = ("login", "secret", "endpoint")
RESULT = "n_assign long, n_access long, n_hex long, n_login long, n_secret long, n_endpoint long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, BASE[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class _Scopes:
    """Spans by start; tells whether one of them shares a scope with a given span."""

    def __init__(self, spans, block, reach):
        self.at, self.block, self.reach = sorted((s, e) for s, e in spans), block, reach
        self.starts = [s for s, _ in self.at]
        self.longest = []  # of the spans up to each, the one that ends last
        for x in self.at:
            self.longest.append(max(x, self.longest[-1] if self.longest else x, key=lambda y: y[1]))

    def near(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, start)
        for s, e in (*self.at[max(0, i - 1):i + 1], *self.longest[max(0, i - 1):i]):
            if self.block(s) == self.block(start) and s - end <= self.reach and start - e <= self.reach:
                return True
        return False


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs with a host, and hosts with a port: of a run of host characters, what stands after its last empty label."""
    found = []
    for m in ENDPOINT.finditer(text):
        start = m.start()
        if m[1] is not None:
            host = m[1][m[1].rfind("..") + 2 if ".." in m[1] else 0:].lstrip(".-")
            if not HOST.fullmatch(host):
                continue
            start = m.end(1) - len(host)
        found.append((start, m.end()))
    return found


def linked_spans(text: str, base, reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak candidates whose complementary parts are in scope."""
    if not base:
        return []
    cuts = [m.end() for m in BLANK.finditer(text)]
    block = lambda p: bisect.bisect_right(cuts, p)
    anywhere = lambda p: 0
    scopes = lambda spans: _Scopes(spans, block, reach)
    covered = _Scopes([(s, e) for s, e, _ in base], anywhere, -1)
    access = [(s, e) for s, e, k in base if k == "access"]
    of_access = _Scopes(access, anywhere, -1)
    known = [(s, e) for s, e, k in base if k != "access" and not of_access.near(s, e)]
    ids, keys = scopes(access), scopes(known)
    logins = [(m.start(), m.end()) for m in LOGIN.finditer(text)] if known else []
    logins = [x for x in logins if not covered.near(*x) and keys.near(*x)]
    secrets = [(m.start(), m.end()) for m in SECRET.finditer(text) if _mixed(m[0])] if access else []
    secrets = [x for x in secrets if not covered.near(*x) and ids.near(*x)]
    ids, keys = scopes(access + logins), scopes(known + secrets)
    ends = [x for x in endpoints(text) if ids.near(*x) and keys.near(*x)] if ids.at and keys.at else []
    return [(*x, kind) for kind, spans in zip(WEAK, (logins, secrets, ends)) for x in spans]


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_text(text: str | None, reach: int = REACH) -> tuple:
    base = base_spans(text or "")
    more = linked_spans(text or "", base, reach)
    kinds = [k for _, _, k in base] + [k for _, _, k in more]
    order = (*BASE, *WEAK)
    spans = sorted(base + more, key=lambda x: (x[0], order.index(x[2])))
    return (*(kinds.count(k) for k in order), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans))


def scan(df: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Every row with its counts, base digest and spans (kind:start:end, comma-joined)."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([scan_text(t, reach) for t in texts], columns=names)

    cols = [c for c in df.columns if c not in names]
    return df.withColumn("__tx_scan", run(F.col(text_col))).select(*cols, *[F.col("__tx_scan")[n].alias(n) for n in names])
