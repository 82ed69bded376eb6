"""Factors are what they are said to be: phrases that stand at their place, as long as can be."""

import random

import pytest
from samples import words
from test_text_ops import shared_passages

from tidemark.llm import substring_dedup as S


def nested(seed, n=50):
    """Passages that hold parts of others, so that places of neighbouring windows differ."""
    rng = random.Random(seed)
    base = words(200, 0, "p").split()
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(180)
            parts += base[a : a + rng.randint(5, 70)] if rng.random() < 0.7 else words(rng.randint(1, 20), rng.randrange(10**6)).split()
        rows.append((rng.choice([i, i, 9]), " ".join(parts)))
    return rows + [(60, " ".join(base)), (61, " ".join(base[:100] * 3)), (None, " ".join(base)), (62, None), (63, "")]


@pytest.mark.parametrize("rows", [nested(1), nested(2), shared_passages(3)])
@pytest.mark.parametrize("block_bytes", [400, 10**6])
def test_factors_stand_at_their_places(docs, rows, block_bytes, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", (block_bytes, block_bytes))
    monkeypatch.setattr(S, "ROW_WINDOWS", 1)
    by_id = {}
    for i, t in rows:
        if i is not None:
            by_id.setdefault(i, []).append((t or "").split())
    runs = {i: {n: {tuple(w[k : k + n]) for w in ws for k in range(len(w) - n + 1)} for n in range(13, 15)} for i, ws in by_id.items()}
    out = S.dedup_substrings(docs(rows)).collect()
    assert len(out) == len(rows) and sum(len(r["factors"]) for r in out) > 10
    blocks = {}
    for r in out:
        w, at = (r["text"] or "").split(), 0
        for f, after in zip(r["factors"], [*r["factors"][1:], None]):
            a, n = f["start"], f["n_words"]
            assert a >= at and n > 0  # in order, without overlaps
            at = a + n
            assert f["source_id"] < r["doc_id"]
            assert any(s[f["source_start"] : f["source_start"] + n] == w[a : a + n] for s in by_id[f["source_id"]])
            assert blocks.setdefault(f["source_id"], f["block"]) == f["block"]
            if at < len(w) and not (after and after["start"] == at):  # nothing takes over: no smaller document goes on, wherever
                window = tuple(w[at - 12 : at + 1])
                assert len(window) < 13 or not any(window in x[13] for i, x in runs.items() if i < r["doc_id"])
    assert (len(set(blocks.values())) > 1) == (block_bytes == 400)


def test_a_phrase_that_no_document_holds_is_no_factor(docs):
    rows = [(1, words(13)), (2, words(13, 1)), (3, words(14))]
    got = {r["doc_id"]: [tuple(f)[:2] + (f["source_id"], f["source_start"]) for f in r["factors"]] for r in S.dedup_substrings(docs(rows)).collect()}
    assert got == {1: [], 2: [], 3: [(0, 13, 1, 0), (13, 1, 2, 12)]}


def test_a_hot_passage_and_long_texts(docs):
    passage = words(60, 0, "h")
    rows = [(i, f"{words(20, 100 * i + 10**6)} {passage}") for i in range(200)] + [(500, words(50_000, 10**8) + " " + passage)]
    out = {r["doc_id"]: r for r in S.dedup_substrings(docs(rows)).collect()}
    assert all([(f["n_words"], f["source_id"], f["source_start"]) for f in out[i]["factors"]] == [(60, 0, 20)] for i in range(1, 200))
    assert out[500]["n_removed"] == 60 and out[0]["n_removed"] == 0
