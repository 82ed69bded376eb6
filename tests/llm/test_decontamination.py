"""Decontamination against the rule as it is written, on repeats, ties, long texts and hot words."""

import random
import re

import pytest
from samples import words
from test_text_ops import LOWER

from tidemark.llm import decontaminate as D


def plain(rows, items, size=13, share=20):
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows_and_items(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice("the of and cat dog sun".split()) if rng.random() < 0.6 else f"q{k}x{j}" for j in range(rng.choice([1, 3, 13, 14, 30])))) for k in range(25)]
    items += [items[3], (99, items[4][1].upper()), (None, "the cat"), (50, None), (51, "?!")]
    rows = []
    for i in range(80):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.3 else " ".join(rng.choice("the of and cat dog sun".split()) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([i, i, 7, None]), ", ".join(parts)))
    return rows + rows[:5] + [(200, None), (201, ""), (202, words(60_000) + " " + items[2][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_rule(spark, docs, seed, monkeypatch):
    rows, items = rows_and_items(seed)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_words", "2 AS __id")
    want = plain(rows, items)
    got = lambda: sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in D.contamination(docs(rows), bench).collect()), key=str)
    assert got() == want
    kept = D.drop_contaminated(docs(rows), bench)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.select("doc_id", "text").collect() if r["text"] is not None) == sorted((str(i), t) for (i, t) in rows if t is not None and not plain([(i, t)], items)[0][4])
    monkeypatch.setattr(D, "BROADCAST_ROWS", 1)  # shuffled joins
    assert got() == want
    monkeypatch.setattr(D, "MAX_WINDOWS", 40)  # and several passes
    assert got() == want and D.drop_contaminated(docs(rows), bench).count() == kept.count()
