"""Licences wherever they stand in a text, and runs of words against brute force."""

import random
import textwrap

from pyspark.sql import functions as F

from examlake.llm import licenses

PROSE = "The boat came late and nobody on the quay had waited for it. "


def scanned(spark, rows, **how):
    return {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def test_whole_texts_and_headers_are_found(spark):
    texts = [(name, t) for name, of in licenses.TEMPLATES.items() for t in of]
    rows = []
    for i, (_, t) in enumerate(texts):
        rows += [(3 * i, t), (3 * i + 1, PROSE * 40 + "\n" + "\n".join(textwrap.wrap(t, 31)) + "\n" + PROSE * 40), (3 * i + 2, PROSE * 9 + t + " " + PROSE * 9)]
    got = scanned(spark, rows)
    for i, (name, _) in enumerate(texts):
        for k in (3 * i, 3 * i + 1, 3 * i + 2):
            best = max(got[k], key=lambda x: x["dice"], default=None)
            assert best and best["license"] == name, (name, k % 3, got[k])


def test_notices_over_line_ends_and_among_other_words(spark):
    rows = [(1, f"{PROSE}\nReleased under\nthe MIT License.\n{PROSE}"), (2, f"{PROSE * 3}All of it is licensed under CC BY 4.0. {PROSE * 3}\n{PROSE}"), (3, PROSE * 20), (4, "Released under the MIT License.\n" + PROSE * 3 + "\nlicensed under CC\n\n BY-NC 4.0")]
    got = {k: [(x["line"], x["last"], x["license"], x["dice"]) for x in v] for k, v in scanned(spark, rows).items()}
    assert got == {1: [(1, 2, "MIT", 1.0)], 2: [(0, 0, "CC-BY-4.0", 1.0)], 3: [], 4: [(0, 0, "MIT", 1.0), (2, 4, "CC-BY-NC-4.0", 1.0)]}


def test_best_run_against_brute_force(spark):
    rng = random.Random(11)
    forms = {"A": ["a b c d e f"], "B": ["b a c c d b e a"], "C": ["f f f e"]}
    rows = [(i, "".join(rng.choice("abcdefxyz") + rng.choice("    \n") for _ in range(rng.randrange(2, 45)))) for i in range(600)]
    got = scanned(spark, rows, templates=forms, percent=70)
    sets = {n: set(licenses._pairs_of(t[0])) for n, t in forms.items()}
    some = 0
    for k, text in rows:
        w = text.split()
        best = 0.0
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                a = set(zip(w[i : j - 1], w[i + 1 : j], strict=True))
                best = max([best, *(2 * len({f"{x} {y}" for x, y in a} & b) / (len(a) + len(b)) for b in sets.values())])
        assert bool(got[k]) == (best >= 0.7)
        if got[k] and all(x["line"] >= 0 and x["last"] > x["line"] for x in got[k]):
            some += 1
            assert abs(max(x["dice"] for x in got[k]) - best) < 1e-9
    assert some > 3


def test_too_large_a_template_is_an_error(spark):
    big = {"X": [" ".join(f"w{i}" for i in range(licenses.LARGEST + 2))]}
    try:
        licenses.find_licenses(spark.range(1).select(F.lit("x").alias("text")), templates=big)
    except ValueError:
        return
    raise AssertionError
