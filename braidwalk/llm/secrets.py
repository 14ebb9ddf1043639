"""Secret scan: fixed key patterns, and sliding-window entropy per character class over candidate strings.

Base patterns (leftmost, not overlapping within a kind) are always reported.  The method adds spans: over each run of
a character class of at least ``WINDOW`` characters, the Shannon entropy of every window of ``WINDOW`` characters is
kept by incremental counts; windows at or over the class's threshold merge into a span, which takes in what is left of
the run on a side if that is shorter than a window.  A span is suppressed if the
whole candidate or the span matches the allow-list, or if a base span covers it.

Texts: null counts as empty (no spans); whole texts of any length in one pass; repeated rows give repeated results; an
empty table gives an empty result; spans of equal start are listed by kind, then end.  Columns of the input pass through,
but those with the name of a result give way to it (redaction has none: it returns the input's columns).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

#: The base patterns, in the order in which kinds at the same start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs of 24 and more

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class, its runs, least entropy of a window in bits a character.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    ("entropy_alnum", re.compile(r"[A-Za-z0-9]{20,}"), 3.7),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
#: What is no secret although its entropy is high.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9/_=+-]+"),  # numbers and dates
    re.compile(r"[A-Za-z/_=+-]+"),  # words and paths of words
    re.compile(r"(?i).*(example|sample|placeholder|changeme|dummy|abcdefghij|0123456789|xxxxx).*"),
    re.compile(r"/?[a-z0-9_]{1,19}(/[a-z0-9_]{1,19})+/?"),  # paths of short parts
    re.compile(r"[a-z0-9]{1,15}([-_][a-z0-9]{1,15})+"),  # slugs
)
#: c log2 c for counts within a window.
_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOWED)


def entropies(s: str, window: int = WINDOW) -> list[float]:
    """Entropy of every window of ``s``; one character enters and one leaves at each step."""
    table = _C if window <= WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, out, top = 0.0, [], math.log2(window)
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += table[c + 1] - table[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += table[c - 1] - table[c]
        if i >= window - 1:
            out.append(top - total / window)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def method_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans the entropy finds beside the base ones; one kind a place, the first class that sees it."""
    out: list[tuple[int, int, str]] = []
    starts, ends, far = [b[0] for b in base], [], 0
    for b in base:
        far = max(far, b[1])
        ends.append(far)

    def covered(lo: int, hi: int) -> bool:
        k = bisect_right(starts, lo)
        return bool(k) and ends[k - 1] >= hi

    for cand in CANDIDATE.finditer(text):
        whole = cand[0]
        if covered(*cand.span()) or allowed(whole):
            continue
        taken: list[tuple[int, int, str]] = []
        for kind, runs, least in CLASSES:
            for run in runs.finditer(whole):
                lo = None
                h = entropies(run[0])
                for i, x in enumerate([*h, -1.0]):
                    if x >= least:
                        lo = i if lo is None else lo
                        hi = i + WINDOW
                    elif lo is not None and (x < 0 or i >= hi):  # windows that touch have merged
                        # what is left of the run is too short to be judged alone: it belongs to the span
                        s, e = run.start() + (lo if lo >= WINDOW else 0), run.start() + (hi if len(run[0]) - hi >= WINDOW else len(run[0]))
                        lo = None
                        if allowed(whole[s:e]):
                            continue
                        # of spans that overlap the first class names the place, unless a wider class sees more of it
                        under = [t for t in taken if s < t[1] and t[0] < e]
                        if all(s <= t[0] and t[1] <= e for t in under) and (not under or (s, e) != under[0][:2]):
                            taken = [t for t in taken if t not in under] + [(s, e, kind)]
        out += [(cand.start() + s, cand.start() + e, kind) for s, e, kind in taken if not covered(cand.start() + s, cand.start() + e)]
    return out


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind: (start, end, kind) in code points, end exclusive."""
    base = base_spans(text)
    return base, sorted(base + method_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def digest(text: str) -> tuple:
    base, every = spans(text)
    n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return (*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every))


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with each stretch of found spans replaced."""
    out, at = [], 0
    for s, e, _ in spans(text)[1]:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def scan_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, and n_assign, n_access, n_hex, base_sha256, spans; no shuffle."""
    from .common import each_text

    return each_text(docs, lambda: digest, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; a null text stays null."""
    from pyspark.sql import functions as F

    from .common import each_text, packed, unpacked

    rows = packed(docs, F.col("text").isNull().alias("none"))
    out = each_text(rows, lambda: lambda t: (redacted(t),), "redacted string")
    return unpacked(out, docs, F.when(~F.col("none"), F.col("redacted")))
