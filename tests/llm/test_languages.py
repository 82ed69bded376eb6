"""Language identification: many languages, whole texts, all four kinds of evidence by their formulas, and the query by brute force."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as L


def fused(rows, n):
    """log posteriors of (declared, host, domain, suffix, likelihoods) by the formulas as they are written."""
    text = [int(np.argmax(r[4])) for r in rows]
    overall = [(text.count(k) + L.SMOOTH_ALL / n) / (len(rows) + L.SMOOTH_ALL) for k in range(n)]
    by = [{v: Counter(text[i] for i, r in enumerate(rows) if r[c] == v) for v in {r[c] for r in rows} - {None}} for c in range(4)]
    out = []
    for i, r in enumerate(rows):
        p = []
        for k in range(n):
            mine = text[i] == k
            level = overall[k]
            for c, weight in ((2, L.SMOOTH_DOMAIN), (1, L.SMOOTH_HOST)):
                if r[c] is not None:
                    seen = by[c][r[c]]
                    level = (max(seen[k] - mine, 0) + weight * level) / (sum(seen.values()) - 1 + weight)
            term = r[4][k] + np.log(level)
            for c in (0, 3):
                if r[c] is not None:
                    known = sum(x[k] for x in by[c].values())
                    term += np.log((max(by[c][r[c]][k] - mine, 0) + L.SMOOTH_DECLARED / len(by[c])) / (known - mine + L.SMOOTH_DECLARED))
            p.append(term)
        out.append(p)
    return out


def test_all_evidence_by_the_formulas(spark):
    en, de = "the cat and the dog of this house is on that road", "der hund und die katze ist auf dem haus mit nicht ein"
    model = L.fit([(en, "en"), (de, "de")])
    rows = [(i, *r) for i, r in enumerate([(en, "en", "a.x.com", "x.com", "com"), (de, "de", "b.x.com", "x.com", "com"), (de, "de", "c.y.de", "y.de", "de"), (en, "de", "c.y.de", "y.de", "de"), (de, None, "c.y.de", "y.de", "de"), ("an", None, None, None, "de"), ("in", "xx", "z", None, None), (None, "en", "c.y.de", "y.de", "de"), (en, None, None, "x.com", None)])]
    df = spark.createDataFrame(rows, "i int, t string, c string, h string, d string, s string")
    ll = [r["ll"] for r in df.select("i", L.likelihoods(F.col("t"), model).alias("ll")).orderBy("i").collect()]
    got = L.identify(df, model, F.col("t"), F.col("c"), F.col("h"), F.col("d"), F.col("s")).orderBy("i").collect()
    for r, p, row in zip(got, fused([(*x[2:], s) for x, s in zip(rows, ll)], 3), rows, strict=True):
        if row[1]:
            assert r["language"] == [*model.languages, "und"][int(np.argmax(p))] and r["confidence"] == pytest.approx(1 / np.exp(np.array(p) - max(p)).sum())
        else:
            assert r["language"] == "und" and not r["accepted"]


def test_every_language_of_the_column_is_fitted(spark):
    rows = [(3 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{'xyz'[j]} " * 20, f"l{k:03d}") for k in range(230) for j in range(3)]
    docs = spark.createDataFrame(rows + [(None, None, "l000"), (10**6, "x", None), (10**6, "x", "und")], "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert model.languages == [f"l{k:03d}" for k in range(230)] and model.rows().shape == (231, L.BUCKETS)
    assert np.allclose(np.exp(model.rows().astype(float)).sum(1), 1, atol=1e-3)


def test_whole_texts_are_learnt_and_read(spark):
    """The end of a long text counts as its beginning does."""
    noise = "1234 " * 60_000
    docs = spark.createDataFrame([(1, noise + "alpha beta gamma " * 50, "a"), (2, noise + "omega sigma theta " * 50, "b")], "doc_id long, text string, lang string")
    model = L.learn(docs)
    asked = docs.select("doc_id", "lang", F.when(F.col("doc_id") == 1, noise * 2 + "beta gamma alpha " * 20).otherwise(noise * 2 + "sigma theta omega " * 20).alias("text"))
    assert all(r["language"] == r["lang"] for r in L.identify(asked, model, F.col("text")).collect())


def test_pages_with_open_tags_take_no_longer(spark):
    pages = ["<script " * 20_000, "<!-- " * 40_000 + "x", "a<" * 100_000, "<style>" * 20_000, "<p>shown</p><script>no</script> <!-- no --> &amp;end", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    began = time.time()
    got = [r[0] for r in df.orderBy("i").select(L.page_text(F.col("h"))).collect()]
    assert time.time() - began < 20
    assert got[4].split() == ["shown", "end"] and got[5] == "" and got[1].strip() == ""


def test_the_query_by_its_formulas(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()
    from tidemark.llm import registry

    got = {r["page_id"]: r for r in registry.QUERIES["op4_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    model = L.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = []
    for p in pages:
        host = (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", p["url"] or "") or [None, ""])[1].lower()
        lang = re.search(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", p["html"] or "", re.I)
        lang = lang[1].lower() if lang and lang[1].lower() != "x" else None
        domain = re.search(r"([^.]+[.][^.]+)$", host)
        rows.append((p["page_id"], p["html"], lang, host or None, domain[1] if domain else None, host.split(".")[-1] or None))
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, html string")
    ll = {r["page_id"]: r["ll"] for r in df.select("page_id", L.likelihoods(L.page_text(F.col("html")), model).alias("ll")).collect()}
    names = [*model.languages, "und"]
    for r, p in zip(rows, fused([(*x[2:], ll[x[0]]) for x in rows], len(names))):
        found = got[r[0]]
        assert (found["declared"], found["host"]) == (r[2], r[3])
        if found["language"] != "und":
            assert found["language"] == names[int(np.argmax(p))] and found["confidence"] == pytest.approx(1 / np.exp(np.array(p) - max(p)).sum(), abs=1e-5)
