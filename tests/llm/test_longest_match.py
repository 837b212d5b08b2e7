"""Longest verbatim matches against brute force."""

import random
import re

import pytest

from examlake.llm import decontaminate


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_longest(text, items):
    """(length, item_id, item_start, doc_start) of the longest match; ties: place in the text, item, place in the item."""
    w, best = alnum(text), None
    for k, item in items:
        v = alnum(item)
        for j in range(len(v)):
            for i in range(len(w)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n:
                    best = min(x for x in (best, (-n, i, k is None, k or "", j)) if x)
    return best and (-best[0], best[3] if not best[2] else None, best[4], best[1])


@pytest.mark.parametrize("case", ["whole", "batches", "blocks"])
def test_longest_benchmark_match_of_every_document(spark, monkeypatch, case):
    rng = random.Random(8)
    word = lambda n, k: rng.choices([f"w{x}" for x in range(n)], k=k)
    items = [(str(i), " ".join(word(6, rng.choice([1, 2, 5, 14, 40])))) for i in range(12)] + [("7", "solo"), ("3", None), (None, "w1 w2 solo w3")]
    copied = " ".join(word(60, 30))  # longer than the depth of 13
    items += [("20", copied), ("21", "x " + copied + " y"), ("4", copied[: len(copied) // 2])]
    docs = [(i, " ".join(word(9, rng.choice([0, 1, 3, 20, 60])))) for i in range(40)]
    docs += [(100 + i, f"{' '.join(word(9, i))} {copied} y" if i % 2 else copied) for i in range(8)]  # copies of one passage
    docs += [(200, copied[40:]), (201, copied[:-20]), (202, "nothing of it"), (203, "and solo."), (204, None), (205, "W1")]
    if case == "batches":
        whole = decontaminate.slices
        monkeypatch.setattr(decontaminate, "slices", lambda b, c, most: whole(b, c, 300))
    if case == "blocks":
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    got = decontaminate.matches(frame, spark.createDataFrame(items, "item_id string, text string")).collect()
    found = {r["doc_id"]: r["longest"] and tuple(r["longest"][c] for c in ("length", "item_id", "item_start", "doc_start")) for r in got}
    assert found == {k: brute_longest(t, items) for k, t in docs}
    assert all(found[k][0] >= 30 for k in range(100, 108)) and found[203][0] == 1 and found[202] is None
