"""Toxic words of a smaller language, known by how they begin, are learnt beside those of a larger one."""

import random

from tidemark.llm import toxicity


def two_languages(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        small, toxic = rng.random() < 0.3, rng.random() < 0.15
        parts = ["quar", "vebo", "lédi", "zent", "ossa", "mipu"] if small else ["kare", "losto", "miva", "thon", "ingly", "ster"]
        word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
        w = [word() for _ in range(rng.randint(150, 300))]
        if small:  # the sequences are inside ordinary words too
            w += [word() + "vébra" + word() for _ in range(3)]
        bad = ["vébra" + word() for _ in range(rng.randint(2, 5) if toxic else rng.random() < 0.1)] if small else [rng.choice(["scumbag", "idiotic", "wretched"]) for _ in range(4 * toxic)]
        for b in bad:
            w.insert(rng.randrange(len(w)), b)
        rows.append((" ".join(w), int(toxic), small))
    return rows


def test_a_smaller_language_is_learnt():
    model = toxicity.fit([(t, y) for t, y, _ in two_languages(1500, 1)])
    rows = two_languages(600, 2)
    found = toxicity.score_texts([t for t, _, _ in rows], model) >= 0.5
    for small in (False, True):
        of = [bool(f) for f, (_, y, s) in zip(found, rows) if y and s == small]
        assert sum(of) >= 0.7 * len(of)
    assert sum(f and not y for f, (_, y, _) in zip(found, rows)) <= 0.05 * len(rows)


def test_both_dictionaries_are_trained_on_their_class():
    rows = two_languages(1500, 1)
    model = toxicity.fit([(t, y) for t, y, _ in rows])
    assert model.toxic.startswith(model.ordinary.rstrip(b"\1")) and len(model.toxic) == len(model.ordinary)
    added = model.toxic[len(model.ordinary.rstrip(b"\1")) :]
    assert all(w in added for w in (b"scumbag", b"idiotic", b"wretched", "vébra".encode()))
    assert not any(w in model.ordinary for w in (b" scumbag", b" idiotic", b" wretched"))


def test_the_sample_is_bounded_in_rows_and_bytes_and_holds_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.append(sample) or toxicity.Model(b"", b"", [], [], [], 0.5))
    rows = [(i, f"{'word ' * 50}{i} end") for i in range(60)] + [(None, "x"), (3, None), (7, "again " * 40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 1)], "doc_id long, toxic int")
    toxicity.learn(docs, labels, max_toxic=10, max_ordinary=20)
    toxicity.learn(docs, labels, max_bytes=600)
    toxicity.learn(docs, labels, max_bytes=1)
    whole = {t for _, t in rows}
    assert all(t in whole for s in seen for t, _ in s)
    assert [sum(y == k for _, y in seen[0]) for k in (1, 0)] == [10, 20]
    assert all(sum(len(t) for t, y in seen[1] if y == k) <= 600 for k in (0, 1)) and len(seen[1]) == 4
    assert sorted(y for _, y in seen[2]) == [0, 1]


def test_the_query_by_language(spark):
    """Held-out precision and recall on sf0.1; every language's toxic texts are found."""
    import os

    from tidemark.llm import registry

    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        return
    found = registry.QUERIES["op3_toxicity"](spark, sf).where("held_out")
    truth = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = truth.join(found, "doc_id").select("lang", "toxic", "predicted").where("toxic is not null").collect()
    caught = [r for r in rows if r["predicted"]]
    assert sum(r["toxic"] for r in caught) >= 0.9 * len(caught)
    for lang in {r["lang"] for r in rows}:
        mine = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"]]
        assert not mine or sum(mine) >= 0.6 * len(mine), lang
