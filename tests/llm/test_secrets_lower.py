"""The allow-list's paths need a slash; what it lets pass is decided in linear time."""

import math
import random
import re
import string
import time
import uuid

from braidwalk.llm import secrets


def test_lower_case_tokens_are_found():
    rng = random.Random(5)
    for _ in range(50):
        key = "".join(rng.sample(string.ascii_lowercase, 16) + rng.sample(string.digits, 10) + rng.sample("qwxzkv", 6))
        assert [k for _, _, k in secrets.spans(f"use {key} now")[1]] == ["entropy_alnum"]
        assert key not in secrets.redacted(f"use {key} now")
    assert [k for _, _, k in secrets.spans("at 0f3a9c7be18d2465f0a7 end")[1]] == ["entropy_hex"]
    for path in ("usr/local/lib/python3/site_packages", "/var/log/app2/2024/errors/", "some-long-slug-of-many-words-1"):
        assert not secrets.spans(f"see {path} there")[1]


def test_long_runs_take_no_time():
    began = time.process_time()
    for n in (24, 32, 64, 4000):
        secrets.spans("0a1b2c3d" * (n // 8) + "-")
        secrets.spans("a0/" * n + "-")
    assert time.process_time() - began < 2


def test_spans_against_plain_entropy():
    """Every window's entropy worked out anew, merged and filtered in the plainest way."""
    rng = random.Random(6)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "ab", "a1"]

    def bits(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))

    def plain(text, base):
        out, w = [], secrets.WINDOW
        inside = lambda s, e: any(a <= s and e <= b for a, b, _ in base)
        for cand in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if inside(*cand.span()) or secrets.allowed(cand[0]):
                continue
            taken = []
            for kind, runs, least in secrets.CLASSES:
                for run in runs.finditer(cand[0]):
                    high = [i for i in range(len(run[0]) - w + 1) if bits(run[0][i : i + w]) >= least - 1e-9]
                    groups = []
                    for i in high:
                        if groups and i <= groups[-1][1]:
                            groups[-1][1] = i + w
                        else:
                            groups.append([i, i + w])
                    for lo, hi in groups:
                        s = run.start() + (0 if lo < w else lo)
                        e = run.start() + (len(run[0]) if len(run[0]) - hi < w else hi)
                        met = {t for t in taken if max(s, t[0]) < min(e, t[1])}
                        wider = all(s <= t[0] and t[1] <= e for t in met) and (s, e) not in {t[:2] for t in met}
                        if not secrets.allowed(cand[0][s:e]) and wider:
                            taken = [t for t in taken if t not in met] + [(s, e, kind)]
            out += [(cand.start() + s, cand.start() + e, kind) for s, e, kind in taken if not inside(cand.start() + s, cand.start() + e)]
        return out

    found = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append("".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.02 else c for c in [rng.choice(rng.choice(kinds[:5])) for _ in range(rng.randint(5, 70))]))
            parts.append(rng.choice([" ", "-", "/", " token=", "_", ", see "]))
        text = "".join(parts)
        base = secrets.base_spans(text)
        got = secrets.method_spans(text, base)
        assert got == plain(text, base), text
        found += len(got)
    assert found > 100


def test_precision_and_recall_by_class():
    """Random tokens are found, ids and words are not; the README's figures."""
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = "alpha river config stone user index value report cloud north delta".split()
    both = string.ascii_letters + string.digits
    tokens = {"hex": lambda: pick("0123456789abcdef", 32), "base36": lambda: pick(string.ascii_lowercase + string.digits, 32), "base62": lambda: pick(both, 32), "base64": lambda: pick(both + "+/", 43) + "=", "url-safe": lambda: pick(both + "-_", 40)}
    plain = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "slug": lambda: "-".join(rng.choice(words) for _ in range(6)),
        "path": lambda: "/" + "/".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(5)),
        "name": lambda: "_".join(rng.choice(words) for _ in range(5)),
        "date": lambda: f"20{rng.randint(10, 30)}-01-01/2024-12-31",
    }
    for kind, made in tokens.items():
        hit = 0
        for _ in range(300):
            text = f"see here {(x := made())} ok"
            hit += any(min(e, 9 + len(x)) - max(s, 9) >= 0.9 * len(x) for s, e, _ in secrets.spans(text)[1])
        assert hit >= 0.95 * 300, (kind, hit)
    for kind, made in plain.items():
        assert not any(secrets.spans(f"see here {made()} ok")[1] for _ in range(300)), kind
