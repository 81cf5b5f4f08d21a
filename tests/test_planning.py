"""Plans of topics against the rules, one after the other over all rows."""

import random
from collections import Counter, defaultdict

from lexquarry.operators.planning import planned

REGIONS = ["r3", "r1", "r2", "r5", "r4", "r6"]


def rules(rows, order, least):
    cells = Counter((r, t) for r, t, _ in rows if r in order and t is not None)
    cells = {k: n for k, n in cells.items() if n >= least}
    feasible = defaultdict(set)
    for r, t in cells:
        feasible[t].add(r)
    tier = {t: "rare" if len(x) <= 2 else "mid" if len(x) <= 5 else "common" for t, x in feasible.items()}
    used, out, first = Counter(), [], defaultdict(list)
    for r in order:
        pool = [t for (x, t) in cells if x == r]
        by = lambda t: (used[t], -cells[r, t], t)  # noqa: E731, B023
        got = []
        for want in ("rare", "mid", "common"):
            c = sorted((t for t in pool if tier[t] == want and t not in got), key=by)
            got += c[:1]
        got = (got + sorted((t for t in pool if t not in got), key=by)[: max(0, 4 - len(got))])[:4]
        for i, t in enumerate(got, 1):
            used[t] += 1
            first[r].append(t)
            out.append(("F1", r, t, None, i, cells[r, t]))
    inside = Counter((r, t, d) for r, t, d in rows if r in order and t is not None and d is not None)
    for r in order:
        pairs = sorted(((t in first[r], -n, d, t) for (x, t, d), n in inside.items() if x == r and n >= least))
        for i, (_, n, d, t) in enumerate(pairs[: min(max(6 - len(first[r]), 2), 4)], 1):
            out.append(("F2", r, t, d, i, -n))
    for j, t in enumerate(sorted((t for t, x in feasible.items() if len(x) >= 3), key=lambda t: (-len(feasible[t]), t))[:8]):
        for i, r in enumerate(sorted(feasible[t], key=lambda r: (-cells[r, t], order.index(r)))[:2]):
            out.append(("F3", r, t, None, 2 * j + i + 1, cells[r, t]))
    return sorted(map(str, out))


def test_families(spark):
    rng = random.Random(12)
    rows = [(rng.choice([*REGIONS, "elsewhere", None]), f"t{min(rng.randrange(60), rng.randrange(60))}" if rng.random() < 0.98 else None, rng.choice([f"d{rng.randrange(4)}", None])) for _ in range(3000)]
    rows += [("r1", "only", "d1")] * 9 + [("r1", "tie", "d1")] * 9
    df = spark.createDataFrame(rows, "region string, topic string, document string").repartition(3)
    for least in (3, 7):
        got = sorted(str(tuple(r)) for r in planned(df, REGIONS, least).select("family", "region", "topic", "document", "place", "n").collect())
        assert got == rules(rows, REGIONS, least) and any("F2" in x for x in got) and any("F3" in x for x in got)
    assert planned(df.limit(0), REGIONS, 3).count() == 0
