"""Similarity and resolution against brute force."""

import random

from tallyline.functions.similarity import jaro, jaro_winkler
from tallyline.operators.resolve import resolve, similar_pairs
from pyspark.sql import functions as F


def brute(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = list(b), []
    for i, ch in enumerate(a):
        spot = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1))
                     if free[j] == ch), None)
        if spot is not None:
            free[spot] = None
            hits.append(ch)
    if not hits:
        return 0.0
    other = [c for c, f in zip(b, free) if f is None]
    m = len(hits)
    half = sum(x != y for x, y in zip(hits, other)) / 2
    j = (m / len(a) + m / len(b) + (m - half) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j)


def mutate(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        i, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.3 and s:
            s.pop(min(i, len(s) - 1))
        elif what < 0.6:
            s.insert(i, rng.choice("abcdefg 123-"))
        elif len(s) > 1:
            i = min(i, len(s) - 2)
            s[i], s[i + 1] = s[i + 1], s[i]
    return "".join(s) or "q"


NAMES = ("rj45 connector|cat6 cable|hex bolt|half inch conduit|safety glasses|zip ties|a-14|bin c-7|"
         "aisle 5 shelf 2|paper towels|wd40|tape|ab|abc|washer m8|small ring|red widget|"
         "large flange coupling with gasket and sixteen bolts|x").split("|")


def test_known_scores(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"),
                                ("", ""), ("a", "")], "a string, b string").coalesce(1)
    got = [(round(r.j, 4), round(r.w, 4)) for r in df.select(
        jaro("a", "b").alias("j"), jaro_winkler("a", "b").alias("w")).collect()]
    assert got[0] == (0.9444, 0.9611) and got[1][1] == 0.84 and got[2][0] == 0.7667
    assert got[3] == (1.0, 1.0) and got[4] == (0.0, 0.0)


def _join_is_lossless(spark, threshold):
    rng = random.Random(7)
    left = sorted({mutate(rng, rng.choice(NAMES)) for _ in range(250)})
    right = sorted({mutate(rng, rng.choice(NAMES)) for _ in range(200)})
    frame = lambda xs: spark.createDataFrame([(x, "f") for x in xs], "s string, form string")
    got = {(r.q, r.k): r.score for r in similar_pairs(frame(left), frame(right), threshold).collect()}
    want = {(a, b) for a in left for b in right if brute(a, b) >= threshold}
    assert set(got) == want
    assert all(abs(brute(*p) - s) < 1e-9 for p, s in got.items())


def test_similarity_join_loses_nothing(spark):
    _join_is_lossless(spark, 0.85)


def test_similarity_join_high_threshold(spark):
    _join_is_lossless(spark, 0.98)


def test_locations(spark):
    dim = spark.createDataFrame([
        ("LOC-A14", "Bin A-14", ["A-14", "A fourteen", "bin A 14"]), ("LOC-C7", "Bin C-7", ["C-7"]),
        ("LOC-AISLE5-S2", "Aisle 5 Shelf 2", ["aisle 5 shelf 2"])],
        "id string, name string, aliases array<string>")
    q = spark.createDataFrame([(x,) for x in (
        "A-14", "a 14", "a14", "bin a-14", "C-7", "aisle 5 / shelf 2", "zz-99", "")], "t string")
    got = {r.t: r.lid for r in resolve(q, "t", dim, "id", "lid", "sc", code=True).collect()}
    assert got == {"A-14": "LOC-A14", "a 14": "LOC-A14", "a14": "LOC-A14", "bin a-14": "LOC-A14",
                   "C-7": "LOC-C7", "aisle 5 / shelf 2": "LOC-AISLE5-S2", "zz-99": None, "": None}


def test_parts_and_ties(spark):
    dim = spark.createDataFrame([
        ("PN-2", "Cat6 cable", ["Cat6", "category 6 cable"]), ("PN-1", "RJ45 connector", []),
        ("PN-0", "RJ45 connector", [])], "part_number string, name string, aliases array<string>")
    q = spark.createDataFrame([(x,) for x in (
        "RJ45 connectors", "cat 6 cable", "mystery widget", "rj45 connector")], "t string")
    got = {r.t: r.pn for r in resolve(q, "t", dim, "part_number", "pn", "sc", code=False).collect()}
    assert got == {"RJ45 connectors": "PN-0", "cat 6 cable": "PN-2", "mystery widget": None,
                   "rj45 connector": "PN-0"}
