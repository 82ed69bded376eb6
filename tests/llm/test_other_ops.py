"""Mixing, toxicity, languages, revisits, nearest neighbours and the pipeline on small tables."""

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from samples import EDGES, words
from pyspark.sql import functions as F

from tidemark.llm import hilbert_ann, language_id, mix_sources, registry, revisits, toxicity
from tidemark.llm.components import components


def flows(blocks, weights, until):
    """What the ideal mix has given each source by each slot, step by step in fractions."""
    left, out = {s: Fraction(n) for s, n in blocks.items()}, [dict.fromkeys(blocks, Fraction(0))]
    for _ in range(until):
        time, got = Fraction(1), dict(out[-1])
        while time and any(left.values()):
            live = sum(Fraction(weights[s]) for s in left if left[s])
            step = min([time] + [left[s] * live / Fraction(weights[s]) for s in left if left[s]])
            for s in left:
                if left[s]:
                    part = step * Fraction(weights[s]) / live
                    got[s] += part
                    left[s] -= part
            time -= step
        out.append(got)
    return out


def one_by_one(blocks, weights):
    """The source of each slot, by releases and deadlines read off the ideal mix."""
    total = sum(blocks.values())
    flow = flows(blocks, weights, total)
    count, out = dict.fromkeys(blocks, 0), []
    for t in range(total):
        ready = [s for s in sorted(blocks) if count[s] < blocks[s] and flow[t + 1][s] > count[s]]  # released: begun within this slot
        s = min(ready, key=lambda s: (Fraction(count[s] + 1) / Fraction(weights[s]), s))  # the flow ends blocks in this order
        out.append(s)
        count[s] += 1
    return out, flow


def test_every_prefix_of_a_schedule_is_within_a_block():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        blocks = {f"s{i}": rng.choice([1, 2, 5, 40]) for i in range(n)}
        weights = {s: rng.choice([1, 2, 3, 50, 1000, 0.1, Fraction(1, 3)]) for s in blocks}
        slots = mix_sources.exact_slots(blocks, weights)
        want, flow = one_by_one(blocks, weights)
        order = {t: s for s, found in slots.items() for t in found}
        assert [order[t] for t in range(len(want))] == want
        count = dict.fromkeys(blocks, 0)
        for t, s in enumerate(want, 1):
            count[s] += 1
            assert all(abs(count[x] - flow[t][x]) < 1 for x in blocks)


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1, "c": 2, "d": 0.5}])
def test_mix_equals_a_simulation(docs, weights):
    sizes = {"a": 70, "b": 33, "c": 9, "d": 1}
    rows = [(i, "t", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mix_sources.mix(docs(rows), weights, block_rows=4).collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r["slot"], (r["source"], r["source_block"])) == (r["source"], r["source_block"])
    target = weights or {s: Fraction(round(n**0.5 * 10**6)) for s, n in sizes.items()}
    assert [by_slot[k][0] for k in sorted(by_slot)] == one_by_one({s: -(-n // 4) for s, n in sizes.items()}, target)[0]
    assert sorted(by_slot) == list(range(len(by_slot)))


def test_mix_of_odd_rows(docs):
    rows = [(None, None, None, None), (1, "x", "en", ""), (1, "x", "en", ""), (2, None, "en", None)]
    got = mix_sources.mix(docs(rows), block_rows=1)
    assert got.columns.count("slot") == 1 and sorted(r["position"] for r in got.collect()) == [0, 1, 2, 3]
    assert mix_sources.mix(docs(rows).where("false")).count() == 0


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    bad = ["scumbag", "idiotic", "wretched"]
    rows = []
    for i in range(n):
        w = [f"{rng.choice(['ka', 'lo', 'mi'])}{rng.choice(['ren', 'sto', 'va'])}{rng.choice(['x', 'ly', 'ing'])}" for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark, docs):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(1, None), (None, 1), (0, rows[0][2])], "doc_id long, toxic int")
    model = toxicity.learn(docs([r[:2] for r in rows]), labels)
    held = docs([r[:2] for r in rows[300:]] + [(1000, None), (1001, ""), (1002, words(40_000))])
    got = {r["doc_id"]: r["s"] for r in held.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5 and got[1002] < 0.5
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[300:])
    assert right >= 95


def test_toxicity_without_a_class(spark, docs):
    model = toxicity.learn(docs(EDGES), spark.createDataFrame([(5, 0)], "doc_id long, toxic int"))
    assert docs(EDGES).select(toxicity.score(F.col("text"), model).alias("s")).where("s >= 0.5").count() == 0
    empty = toxicity.learn(docs(EDGES).where("false"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert docs(EDGES).select(toxicity.score(F.col("text"), empty)).count() == len(EDGES)


def test_op3_query(spark, sf_dir):
    got = registry.QUERIES["op3_toxicity"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_language_model_on_held_out_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.learn(d.where(~odd))
    got = language_id.identify(d.where(odd), model, F.col("text")).select("lang", "language", "accepted").collect()
    assert sum(r["lang"] == r["language"] and r["accepted"] for r in got) >= 0.9 * len(got)


def plain_fusion(rows, n, everything_names):
    """log posteriors by the formulas, from (declared, host, likelihoods)."""
    text = [int(np.argmax(ll)) for _, _, ll in rows]
    S = language_id
    overall = [(text.count(k) + S.SMOOTH_ALL / n) / (len(rows) + S.SMOOTH_ALL) for k in range(n)]
    out = []
    kinds = len({d for d, _, _ in rows if d is not None}) or 1
    for r, (d, h, ll) in enumerate(rows):
        p = []
        for k in range(n):
            mine = text[r] == k
            host = [text[i] for i, x in enumerate(rows) if x[1] == h]
            prior = (max(host.count(k) - mine, 0) + S.SMOOTH_HOST * overall[k]) / (len(host) - 1 + S.SMOOTH_HOST) if h is not None else overall[k]
            term = ll[k] + np.log(prior)
            if d is not None:
                same = sum(text[i] == k for i, x in enumerate(rows) if x[0] == d)
                known = sum(text[i] == k for i, x in enumerate(rows) if x[0] is not None)
                term += np.log((max(same - mine, 0) + S.SMOOTH_DECLARED / kinds) / (known - mine + S.SMOOTH_DECLARED))
            p.append(term)
        out.append(p)
    return out


def test_evidence_is_fused_by_the_formulas(spark):
    en, de = "the cat and the dog of this house is on that road", "der hund und die katze ist auf dem haus mit nicht ein"
    model = language_id.fit([(en, "en"), (de, "de")])
    rows = [(i, t, d, h) for i, (t, d, h) in enumerate([(en, "en", "a"), (de, "de", "b"), (en, "de", "a"), ("the", "de", "b"), ("zq", None, "b"), (None, "en", None), ("", None, None), (de, "xx", "a"), ("12 34", "en", "a")])]
    df = spark.createDataFrame(rows, "i int, t string, d string, h string").withColumn("language", F.lit("clash"))
    scored = df.select("i", language_id.likelihoods(F.col("t"), model).alias("ll")).orderBy("i").collect()
    got = language_id.identify(df, model, F.col("t"), F.col("d"), F.col("h")).orderBy("i").collect()
    names = [*model.languages, "und"]
    for r, p, (_, t, _, _) in zip(got, plain_fusion([(d, h, s["ll"]) for (_, _, d, h), s in zip(rows, scored)], 3, names), rows, strict=True):
        if any(c.isalpha() for c in t or ""):
            assert r["language"] == names[int(np.argmax(p))]
            assert r["confidence"] == pytest.approx(1 / np.exp(np.array(p) - max(p)).sum())
        else:
            assert r["language"] == "und" and not r["accepted"]
    assert language_id.identify(df.where("false"), model, F.col("t"), F.col("d"), F.col("h")).count() == 0
    none = language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.identify(df, none, F.col("t")).where("accepted").count() == 0


def test_op4_query(spark, sf_dir):
    got = registry.QUERIES["op4_language_id"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert sum(r["language"] == r["declared"] for r in got) >= 0.9 * len(got)


def test_canonical_urls(spark):
    pairs = [("HTTP://www.A.example:80/x/?utm_source=f&b=2&a=1#top", "a.example/x?a=1&b=2"), ("https://a.example", "a.example"), ("https://a.example/", "a.example"), ("a.example/x//", "a.example/x"), (None, None), ("", "")]
    got = spark.createDataFrame([(u,) for u, _ in pairs], "u string").select(revisits.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [k for _, k in pairs]


def test_revisits(spark):
    cols = "capture_id long, url string, ts long, status int, headers map<string,string>, digest string, n_bytes long, span string"
    h = lambda **kw: {k.replace("_", "-"): v for k, v in kw.items()}
    rows = [
        (1, "http://a/x", 10, 200, h(ETag='"1"', Content_Type="text/html", Age="1"), "d1", 5, "q"),
        (2, "https://www.a/x#f", 20, 304, h(etag='W/"1"', content_type="no", age="2", date="z"), None, 0, "q"),
        (3, "http://a/x", 10, 304, h(etag='"1"'), None, 0, "q"),  # not earlier
        (4, "http://a/x", 30, 304, h(etag='"9"'), None, 0, "q"),
        (5, "http://a/x", 30, 304, None, None, 0, "q"),
        (6, "http://a/x", 40, 200, h(Last_Modified="m"), "d2", 6, "q"),
        (7, "http://a/x", 40, 200, h(Last_Modified="n"), "d3", 7, "q"),  # the larger of two at one time
        (8, "http://a/x", 50, 304, h(last_modified="n"), None, 0, "q"),
        (9, None, 50, 304, h(etag="x"), None, 0, "q"),
        (10, "http://a/x", None, 304, h(etag="x"), None, 0, "q"),
        (10, "http://a/x", None, 304, h(etag="x"), None, 0, "q"),
        (11, "http://a/x", 60, 404, None, "d4", 1, "q"),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, cols)).collect()
    by = {r["capture_id"]: r for r in got}
    assert len(got) == 12 and {k: (r["outcome"], r["source_id"]) for k, r in by.items()} == {1: ("response", None), 2: ("resolved", 1), 3: ("no_earlier_response", None), 4: ("validator_mismatch", None), 5: ("no_validator", None), 6: ("response", None), 7: ("response", None), 8: ("resolved", 7), 9: ("no_earlier_response", None), 10: ("no_earlier_response", None), 11: ("response", None)}
    assert by[2]["header_lines"] == ["age: 2", "content-type: text/html", "date: z", 'etag: W/"1"'] and by[2]["digest"] == "d1" and by[2]["n_bytes"] == 5
    assert revisits.resolve(spark.createDataFrame([], cols)).count() == 0


def test_hilbert_neighbours_are_near():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
    order = cells[np.argsort(hilbert_ann.hilbert(cells, 4))]
    assert len({*map(tuple, order)}) == 256 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def plain_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        s = sorted({(-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q})[:k]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(s)]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(z)) for z in rng.standard_normal(6) * rng.choice([0.5, 1, 3])]) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # a vector that repeats
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [1.0]), (905, [float("inf")] * 6), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = hilbert_ann.nearest(df, df.where("vec_id % 20 = 0"), 7)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == plain_nearest(rows, [r for r in rows if r[0] % 20 == 0], 7)
    few = df.where("vec_id < 3")
    assert hilbert_ann.nearest(few, few, 7).count() == 6
    assert hilbert_ann.nearest(df.where("false"), df, 7).count() == 0


def test_op6_recall(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = set(plain_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20))
    pairs = {(q, i) for q, _, i in want}
    got = {(r["query_id"], r["vec_id"]) for r in registry.QUERIES["op6_hilbert_ann"](spark, sf_dir).collect()}
    assert len(got & pairs) >= 0.9 * len(pairs)


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 3), (5, 6), (6, 5), (7, 7), *[(100 + i, 101 + i) for i in range(20)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{100 + i: 100 for i in range(21)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, tmp_path, sf_dir):
    from test_text_ops import plain_classes, plain_cut

    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    plant = [(10**6, "123 456 !!!", "en", "src0", 11), (10**6 + 1, None, "en", "src0", 0)]
    spark.createDataFrame(base.collect() + plant, base.schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    kept = {i: r["text"] for i, r in rows.items() if i < 10**6}  # the planted ones have no language
    classes = plain_classes(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    cut = {i: (k if n != len(k.split()) else kept[i]) for i, n, k in plain_cut(list(kept.items()))}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    clean = {i: r["text"] for i, r in got.items()}
    assert clean.items() <= cut.items() and all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] != rows[r["doc_id"]]["text"])
    gone = spark.createDataFrame([(i, t) for i, t in cut.items()], "doc_id long, text string")
    from tidemark.llm import decontaminate

    bad = {r["doc_id"] for r in decontaminate.contamination(gone, bench).where("contaminated").collect()}
    assert set(got) == set(cut) - bad
    assert len({r["position"] for r in got.values()}) == len(got)
