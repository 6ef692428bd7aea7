"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalith.llm import packing, toxicity
from tests.llm import brute
from tests.llm.test_corpus_operators import AWKWARD, near_copies, tiling

BAD = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    bench = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(4)]
    texts = AWKWARD + near_copies(clusters=4, size=6) + near_copies(clusters=1, size=4)
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 3 == 0:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        if i % 7 == 1:
            half = bench[i % 4].split()
            text += half[12:] + half[:12]
        texts.append(" ".join(text))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id here", "en", "s", 3), (500, texts[-1], "en", "s", 1), (501, "A  b", None, None, None), (501, "A  b", None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if any(b in (t or "") for b in BAD) else 0, 1) for i, t, *_ in rows if i is not None and i < 500], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def test_stages_keep_what_plain_versions_keep(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    before = spark.read.parquet(f"{path}/documents.parquet")
    scores = toxicity.toxicity(before, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1")
    bad = {r["doc_id"] for r in scores.collect()}
    assert len(bad) > 30 and sorted(map(str, kept["toxicity"])) == sorted(str((i, t)) for i, t, *_ in rows if i not in bad)

    first = {}
    for i, t in sorted(kept["toxicity"], key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(brute.SPACE.sub(" ", t or ""), i)
    assert sorted(map(str, (i for i, _ in kept["exact_dedup"]))) == sorted(map(str, first.values()))

    classes = brute.classes({i: t for i, t in kept["exact_dedup"] if i is not None}, 5, 80)
    want = [i for i, _ in kept["exact_dedup"] if i is None or classes[i][1] == i]
    assert len(want) < len(kept["exact_dedup"]) and sorted(map(str, (i for i, _ in kept["jaccard_join"]))) == sorted(map(str, want))

    leaks = {i for i, t in kept["jaccard_join"] if any(tiling(brute.words(t), x.split()) >= 20 for x in bench)}
    assert leaks and sorted(map(str, (i for i, _ in kept["decontaminate"]))) == sorted(str(i) for i, _ in kept["jaccard_join"] if i not in leaks)


def test_run_packs_what_the_stages_keep(spark, folder):
    path, *_ = folder
    got = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    want = packing.pack(docs, packing.tokenizer_path()).groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).collect()
    length = defaultdict(int)
    for r in got:
        length[r["doc_id"]] += r["length"]
    assert dict(length) == {r["doc_id"]: r["n"] for r in want}


def test_empty_tables_pass_all_stages(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
