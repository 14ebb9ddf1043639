"""Low-complexity intervals against the definition."""

import random

from braidwalk.functions.sequences import dust_intervals


def by_definition(s, window=40, threshold=4):
    n, score = len(s), {}
    for a in range(n - 2):
        seen, total = {}, 0
        for b in range(a, min(n - 2, a + window - 2)):
            k = s[b : b + 3]
            total += seen.get(k, 0)
            seen[k] = seen.get(k, 0) + 1
            if b > a:
                score[a, b] = total / (b - a)
    best = [(a, b + 3) for (a, b), r in score.items() if 2 * r > threshold and all(score[x, y] <= r for x in range(a, b) for y in range(x + 1, b + 1))]
    out = []
    for a, b in sorted(best):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_dust():
    rng = random.Random(1)
    for i in range(60):
        s = "".join(rng.choice(rng.choice(["ACGT", "AC", "A", "ACGT"])) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            s = s[:20] + rng.choice(["A", "AC", "ACG"]) * 8 + s[20:]
        assert dust_intervals(s) == by_definition(s), s
