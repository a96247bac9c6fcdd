"""Lookup of known venues against brute force."""

from __future__ import annotations

import random
import re

from marquee.operators import venues


def test_looked_up_like_brute_force(spark):
    """Names, repeated ones among them, against venues, with repeated ids, cities, nulls and names that contain one another."""
    rng = random.Random(31)
    name = lambda: rng.choice([None, "", "--", *("".join(rng.choices("ab ", k=rng.randrange(1, 6))) for _ in range(12))])
    listed = [(i % 25, name(), rng.choice([None, "1 Oak St, Austin", "2 Elm St, Kyle"])) for i in range(30)]
    asked = [(i % 190, name(), rng.choice([None, "", "Kyle", "austin"])) for i in range(200)]
    n = spark.createDataFrame(asked, "id long, name string, city string")
    got = venues.looked_up(n, spark.createDataFrame(listed, "ord long, name string, address string")).select("id", "address")
    key = lambda x: " ".join((x or "").lower().replace("-", " ").split())
    low = lambda rows: min(rows, key=lambda r: (r[0], r[2] is not None, r[2] or ""), default=None)
    want = {}
    for i in {r[0] for r in asked}:
        exact, partial = [], []
        for _, a, city in (r for r in asked if r[0] == i and key(r[1])):
            if (e := low([v for v in listed if key(v[1]) == key(a)])) and e[2] is not None:
                exact.append(e[2])
            partial += [v for v in listed if key(v[1]) and (key(v[1]) in key(a) or key(a) in key(v[1])) and (not city or city.lower() in (v[2] or "").lower())]
        p = low(partial)
        want[i] = min(exact) if exact else p and p[2]
    assert sorted((r.id, r.address or "") for r in got.collect()) == sorted((r[0], want[r[0]] or "") for r in asked)
    assert any(want.values()) and not all(want.values())


def test_names_are_cut_into_runs_once(spark):
    """Runs are made of distinct texts, without the ids of the rows that have them, and those of the names meet the venues' where they are made."""
    n = spark.range(1000).selectExpr("id", "'Hall of Fame' AS name", "'' AS city")
    v = spark.createDataFrame([(1, "Hall", "1 Oak St")], "ord long, name string, address string")
    found = venues.looked_up(n, v)
    cut = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in line]
    assert cut and not any(re.search(r"\bid#", line) for line in cut)
    assert {r.address for r in found.collect()} == {"1 Oak St"}
