"""Substring dedup, near-dedup, decontamination, licences and language models on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import EDGES, words
from pyspark.sql import functions as F

import oracle
from tidemark.llm import decontaminate, license_scan, near_dedup, ngram_lm, registry, shared, substring_dedup
from tidemark.llm import words as W

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_cut(rows, size=13):
    """(id, words, kept words) by the rule as it is written."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shared_passages(seed=0, n=60):
    rng = random.Random(seed)
    passages = [words(rng.randint(8, 40), 1000 * k, "p") for k in range(6)]
    return [(i, " ".join(rng.choice(passages) if rng.random() < 0.5 else words(rng.randint(1, 30), rng.randrange(10**6)) for _ in range(rng.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("rows", [EDGES, shared_passages()])
def test_substring_dedup_is_exact(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", (500, 500))  # many blocks
    monkeypatch.setattr(substring_dedup, "ROW_WINDOWS", 1)
    out = substring_dedup.dedup_substrings(docs(rows))
    assert "slot" in out.columns and out.columns.count("kept_text") == 1
    got = sorted(((r["doc_id"], r["n_words"], r["kept_text"]) for r in out.collect()), key=str)
    assert got == sorted(plain_cut(rows), key=str)
    for r in out.collect():
        assert r["n_removed"] == r["n_words"] - len(r["kept_text"].split()) == sum(f["n_words"] for f in r["factors"])


def test_substring_dedup_of_nothing(docs):
    assert substring_dedup.dedup_substrings(docs(EDGES).where("false")).count() == 0


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (W.unpack(W.pack(v), 1000) == v).all() and len(W.unpack(W.pack(v[:0]), 0)) == 0
    u = rng.integers(0, 2**32, 50, dtype=np.uint32)
    assert (W.unplanes(W.planes(u), 50) == u).all()


def test_words_are_those_of_the_patterns():
    for text in ["", " a  b\x0bc ", "A-b é9 x", "ß\x00y\x7fz", "q" * 5000]:
        for kind, pattern in ((W.SPACED, rb"[^\x20\x09-\x0D]+"), (W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            data, offsets = W.buffers(pa.array([None, text, "tail"]))
            data = W.LOWER[data] if kind is W.ALNUM else data
            s, e, f = W.word_spans(data, offsets, kind)
            blob = data.tobytes()
            assert [blob[a:b] for a, b in zip(s[f[1] : f[2]], e[f[1] : f[2]])] == re.findall(pattern, text.encode().translate(LOWER) if kind is W.ALNUM else text.encode())


def bags(rows, size=5):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(LOWER))
        out[i] = Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else Counter()
    return out


def plain_classes(rows, threshold=0.8):
    bag = bags(rows)
    root = {i: i for i in bag}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in bag if bag[i])
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = bag[ids[a]], bag[ids[b]]
            both = sum((x & y).values())
            if both >= threshold * (sum(x.values()) + sum(y.values()) - both):
                u, v = find(ids[a]), find(ids[b])
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in bag}


def edited(seed=0, n=90):
    rng = random.Random(seed)
    bases = [words(rng.randint(6, 120), 1000 * k, "b") for k in range(8)]
    rows = []
    for i in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(docs):
    rows = edited() + [(1000, None), (1001, ""), (1002, "!!"), (1003, "one two"), (1004, "One, two"), (1005, words(9000, 10**7))]
    out = near_dedup.near_duplicates(docs(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == plain_classes(rows)


def test_near_duplicates_of_odd_rows(docs):
    out = near_dedup.near_duplicates(docs([(None, "a b"), (3, "a b"), (2, "a b"), (2, "c d"), (4, "c d"), (9, None), (9, None)])).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in out), key=str) == sorted([(None, None), (3, 2), (2, 2), (2, 2), (4, 2), (9, 9), (9, 9)], key=str)
    kept = near_dedup.keep_one(docs([(None, "a b"), (3, "a b"), (2, "a b"), (2, "a b"), (4, None)])).select("doc_id", "slot").collect()
    assert sorted((str(r[0]) for r in kept)) == ["2", "4", "None"]
    assert near_dedup.near_duplicates(docs([(1, "x")]).where("false")).count() == 0


def test_members_beyond_the_star_are_compared(docs, monkeypatch):
    """A chain in which the smallest id is near none but its neighbour; buckets are cut into blocks of two."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    w = words(200).split()
    rows = [(i, " ".join(f"c{j}" if j < 4 * i else x for j, x in enumerate(w))) for i in range(12)]
    out = near_dedup.near_duplicates(docs(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == plain_classes(rows)


def test_a_pair_is_compared_in_its_first_bucket_alone(monkeypatch):
    """Texts whose signatures share bands 3, 7 and 12: of the blocks of these buckets that of band 3 compares them."""
    texts = pa.array([words(60), words(60) + " end", words(60, 500), words(60) + " other end"])
    sig = np.arange(4 * near_dedup.K, dtype=np.uint32).reshape(4, near_dedup.BANDS, near_dedup.ROWS)
    sig[:, 12:] = sig[0, 12:]
    sig[:, [3, 7]] = sig[0, [3, 7]]
    compared, cells = [], near_dedup.cells
    monkeypatch.setattr(near_dedup, "cells", lambda t, size: compared.append(len(t)) or cells(t, size))
    run = near_dedup._block_links(5, 0.8, 40)
    found = {}
    for band in (3, 7, 12):
        block = {"node": [1, 2, 3, 4], "part": [0, 0, 0, 0], "comp": [1, 2, 3, 4], "i": [0] * 4, "j": [0] * 4, "band": [band + 1] * 4}
        out = run(pa.table(block | {"sig": [x.tobytes() for x in sig], "t": texts}))
        found[band] = sorted(map(sorted, zip(out["u"].to_pylist(), out["v"].to_pylist(), strict=True)))
    assert found == {3: [[1, 2], [1, 4]], 7: [], 12: []} and compared == [4]


def test_buckets_of_several_classes_lose_no_link(docs, monkeypatch):
    """Clusters that share a third of their words meet in many buckets, in several blocks and beside a smaller centre."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(11)
    common = words(100, 0, "c").split()
    rows = []
    for k in range(12):
        own = words(25, 1000 * (k + 1), "o").split()
        for _ in range(6):
            w = common + own
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(rows[0][0], words(90, 0, "c")), (rows[20][0], rows[40][1])]  # ids of two texts
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(rows)).collect()}
    monkeypatch.undo()
    assert got == classes_of_ids(rows)


def classes_of_ids(rows):
    """plain_classes, where rows of one id are one document."""
    numbered = plain_classes([(n, t) for n, (_, t) in enumerate(rows)])
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for n, (i, _) in enumerate(rows):
        a, b = find(i), find(rows[numbered[n]][0])
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_darts_estimate_weighted_similarity():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(300)), " ".join(rng.choice("abcdefgh") for _ in range(200)), "z", ""]
    units, firsts, _ = near_dedup.cells(pa.array(texts), 2)
    sig = near_dedup.signatures(units, firsts)
    assert (sig[:3] != 0).any(1).all() and not sig[3].any()
    x, y = bags([(0, texts[0]), (1, texts[1])], 2).values()
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.2


def test_decontamination(spark, docs):
    item = words(15, 0, "q")
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (3, "short item"), (4, None), (5, "!!"), (None, "nothing"), (3, "short item")], "item_id long, text string")
    rows = [(1, f"{words(5)} {item.replace(' ', ', ')} tail"), (2, "a Short,  ITEM b"), (3, words(13, 0, "q") + " " + words(300)), (3, words(12, 0, "q")), (4, None), (5, ""), (None, "short item")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(docs(rows), bench).collect()), key=str)
    assert got == sorted([(1, 21, 15, ["1", "2"], True), (2, 4, 2, ["3"], True), (3, 313, 13, ["1", "2"], False), (3, 12, 0, [], False), (4, 0, 0, [], False), (5, 0, 0, [], False), (None, 2, 2, ["3"], True)], key=str)
    whole = decontaminate.drop_contaminated(docs(rows), bench)
    assert whole.columns == docs(rows).columns and whole.where("text is not null").count() == 3
    assert decontaminate.contamination(docs(rows), bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs(rows).where("false"), bench).count() == 0


def test_decontamination_in_passes(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, words(20, 30 * k, "q")) for k in range(5)], "item_id long, text string")
    rows = [(i, f"{words(3, i)} {words(20, 30 * (i % 7), 'q')}") for i in range(14)]
    once = sorted(map(str, decontaminate.contamination(docs(rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 7)
    assert sorted(map(str, decontaminate.contamination(docs(rows), bench).collect())) == once


def test_licenses(docs):
    mit = license_scan._NOTICES["mit-text"][1]
    source = license_scan._NOTICES["bsd-2-text"][1].replace("\n1. ", "\n\n").replace("\n2. ", "\n")
    wrapped = re.sub(r"((?:\S+\s+){8})", r"\1\n", source)
    rows = [(1, f"x\n{mit}\ny"), (2, wrapped), (3, "All MIT licensed? no."), (4, "Prose.\nLicensed under CC BY-NC 4.0.\nSPDX-License-Identifier: GPL-2.0-only"), (5, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), (6, None), (7, ""), (7, ""), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["licenses"]) for r in license_scan.scan(docs(rows)).collect()}
    assert got == {(1, "MIT"), (2, "BSD-2-Clause"), (3, ""), (4, "CC-BY-NC-4.0,GPL-2.0-only"), (5, ""), (6, ""), (7, ""), (None, "MIT")}
    assert license_scan.scan(docs(rows).where("false")).count() == 0


def plain_lm(train, score):
    tok = lambda t: (t or "").encode().translate(LOWER).split() + [None]
    pair, uni = Counter(), Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        pair.update(zip(["<s>", *w[:-1]], w))
    ends, begins, total = Counter(w for _, w in pair), defaultdict(lambda: [0] * 4), Counter()
    for (u, _), c in pair.items():
        begins[u][min(c, 3)] += 1
        total[u] += pair[u, _]
    D, E = (ngram_lm._discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (pair, ends))
    classes = Counter(min(v, 3) for v in ends.values())

    def low(w):
        if not pair:
            return 1 / (len(uni) + 1)
        return max(ends[w] - E[min(ends[w], 3)], 0) / len(pair) + sum(E[k] * classes[k] for k in (1, 2, 3)) / len(pair) / (len(uni) + 1)

    def p(u, w):
        if not total[u]:
            return low(w)
        return max(pair[u, w] - D[min(pair[u, w], 3)], 0) / total[u] + sum(D[k] * begins[u][k] for k in (1, 2, 3)) / total[u] * low(w)

    out = []
    for t in score:
        w = tok(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), sum(uni.values()), sum(math.log10((uni[x] + 1) / (sum(uni.values()) + len(uni) + 1)) for x in w), sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w[:-1]], w))))
    return out


@pytest.mark.parametrize("train", [[], [None, ""], [t for _, t in shared_passages(4, 30)] + ["the the The cat " * 300]])
def test_language_model_equals_the_formulas(spark, docs, train):
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    rows = [(i, t) for i, t in enumerate([None, "", "The cat", "unseen words here", words(30), " ".join(train[0].split()[::-1]) if train and train[0] else "a"])]
    got = ngram_lm.score(docs(rows), model).orderBy("doc_id").collect()
    assert "slot" in got[0].asDict()
    for r, want in zip(got, plain_lm(train, [t for _, t in rows]), strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-9) and r["score"] == pytest.approx(want[4], abs=1e-9)
    assert ngram_lm.score(docs(rows).where("false"), model).count() == 0


def test_mapped_arrays_from_another_store(tmp_path):
    a = np.arange(10, dtype=np.uint64)
    shared.save(f"file://{tmp_path}/x/y", {"a": a, "none": a[:0]})
    assert (shared.mapped(f"file:{tmp_path}/x/y", "a", np.uint64) == a).all() and len(shared.mapped(f"{tmp_path}/x/y", "none", np.uint64)) == 0
    with pytest.raises(FileNotFoundError):
        shared.mapped(f"file://{tmp_path}/x/y", "b", np.uint64)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.check(spark, registry.QUERIES[name], registry.SQL[name], sf_dir)


def test_op1_query_is_exact(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, n - len(k.split()), hashlib.sha256(k.encode()).hexdigest()) for i, n, k in plain_cut(rows)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.QUERIES["op1_substring_dedup"](spark, sf_dir).collect()}
    assert got == want


def test_op8_query_equals_brute_force(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in registry.QUERIES["op8_near_dedup"](spark, sf_dir).collect()} == plain_classes(rows)


def test_op10_query_beats_its_base(spark, sf_dir):
    r = registry.QUERIES["op10_ngram_lm"](spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
