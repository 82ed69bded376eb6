"""The pipeline on nulls, repeats, ties, long texts, clashing columns and empty tables, stage by stage against plain rules."""

import os

import corpus_pipeline
import pytest
from test_decontamination import plain as plain_contamination
from test_text_ops import plain_classes, plain_cut

from tidemark.llm import language_id, mix_sources
from tidemark.sources.cluster import checkpoint_root


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, sf_dir):
    """Documents of four languages with odd rows among them, and columns whose names clash with results."""
    root = tmp_path_factory.mktemp("odd")
    base = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(90).collect()]
    text = base[0][1]
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "", None, None, 0), (10**6 + 2, " 12 !! ", "en", "src0", 7), (10**6 + 3, text, None, None, len(text)), (None, text, "en", "src1", len(text)), (None, text, "en", "src1", len(text)), base[5], base[5], (10**6 + 4, " ".join([t[1] or "" for t in base[:40]]), "en", "src2", 1)]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS slot", "'x' AS kept_text", "2 AS n_words", "'y' AS language", "3 AS __id")
    df.coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    return f"file://{root}"


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_every_stage_by_its_rule(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        after = rows(docs)
        if name == "language_id":
            assert set(docs.columns) == set(columns) and all(any(c.isalpha() for c in t or "") for _, t in after)
            kept = {x for x in before if x[1] and any(c.isalpha() for c in x[1])}
            assert set(after) <= kept and len(set(after)) >= 0.95 * len(kept) and [x for x in before if x in set(after)] == after
        elif name == "minhash_near_dedup":
            whole = [x for x in before if x[0] is not None]
            classes = plain_classes(list({i: t for i, t in whole}.items()))
            assert [x for x in after if x[0] is None] == [x for x in before if x[0] is None]  # no near duplicates
            assert [i for i, _ in after if i is not None] == sorted({i for i, _ in whole if classes[i] == i}, key=str)
        elif name == "substring_dedup":
            want = [(i, k if n != len(k.split()) else t) for (i, t), (_, n, k) in zip(before, plain_cut(before))]
            assert after == sorted(want, key=str)
        elif name == "decontamination":
            bad = {(i, t) for i, t in before if plain_contamination([(i, t)], items)[0][4]}
            assert after == [x for x in before if x not in bad]
        else:
            assert after == before and sorted(r["position"] for r in docs.collect())[0] == 0
            sources = {}
            for r in docs.collect():
                sources.setdefault("=" + r["source"] if r["source"] is not None else "", []).append(r["slot"])
            slots = mix_sources.exact_slots({s: -(-len(x) // 16) for s, x in sources.items()}, mix_sources.targets({s: len(x) for s, x in sources.items()}, None, 0.5))
            assert {s: sorted(set(x)) for s, x in sources.items()} == {s: list(x) for s, x in slots.items()}
        before = after


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_what_stages_leave_is_removed(spark, folder):
    root = checkpoint_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    out = corpus_pipeline.run(spark, folder)
    n = out.count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert n > 40 and left <= {name for name, _ in corpus_pipeline.STAGES}


def test_languages_are_those_of_the_operator(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    found = language_id.identify(docs, language_id.learn(docs), F.col("text"), declared=F.col("lang"), host=F.col("source")).where("accepted")
    assert rows(found) == rows(corpus_pipeline.identify_language(spark, docs, folder))
