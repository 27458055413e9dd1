"""The pipeline's stages on a small table, and its guard in the entry module."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(8)
    body = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(60)) for _ in range(6)]
    leak = " ".join(f"test{k}" for k in range(20))
    texts = [body[0], body[0] + " ", body[1], body[1] + " more", body[2], leak, None, "123", body[3] + " " + leak, body[4] * 40]
    folder = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [{0, 1, 2, 3, 4, 5, 8, 9}, {1, 2, 3, 4, 5, 8, 9}, {1, 2, 4, 5, 8, 9}, {1, 2, 4, 9}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} == ids and docs.count() == len(ids)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == want[-1] and {"sequence_id", "offset", "length"} <= set(packed.columns)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, own long, _hit_id long, id long, spans string"


def test_repeated_and_missing_ids(spark, sf):
    """Rows and not ids are dropped: another text under the id of a copy stays, and so do texts without an id."""
    rng = random.Random(9)
    near = [" ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(900)) for _ in range(80)) for _ in range(5)]
    rows = [(1, near[0]), (2, near[0] + " more"), (2, near[1]), (3, near[2]), (None, near[3]), (None, near[3] + " more"), (None, near[4]), (None, near[2] + " x"),
            (7, near[2]), (7, near[2]), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "r", 5, 6, 7, "s") for r in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), SCHEMA)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(i for i, _ in kept if i) == [1, 2, 3] and {near[0], near[1], near[2], near[4]} <= {t for _, t in kept}
    assert len([t for i, t in kept if i is None]) == 2 and len(kept) == 5


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_the_background_rejects_random_letters(spark):
    from tidemark.llm import language_id

    rng = random.Random(10)
    said = [" ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "trees"]) for _ in range(30)) for _ in range(400)]
    noise = ["".join(rng.choice("qxzjkvwpbghfymucldrnhsiaote") for _ in range(300)) for _ in range(3)]
    rows = [(k, t, "en") for k, t in enumerate(said)] + [(1000 + k, t, None) for k, t in enumerate([*noise, "the river", "A tree " + noise[0], "12", None])]
    kept = language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in kept} == {*range(400), 1003, 1004}


def test_the_language_stage_decides_what_the_others_see(spark, tmp_path):
    """By the text: rows without a language, or with a wrong one, are judged like all others."""
    rng = random.Random(11)
    words = {"en": "the house stands near a river and trees", "de": "das haus steht nahe einem fluss und wald"}
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for k in range(80) for lang in [("en", "de")[k % 2]]]
    rows += [(100, "the river and the trees near the house", None), (101, "das haus und der fluss nahe wald", None),
             (102, "einem haus steht das wald nahe fluss", "en"), (103, "a house near the river stands", "de")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(0, 80, 2), 100, 103}


def test_copies_move_their_texts_three_times(spark, sf):
    """And repeated rows are merged without another exchange."""
    from tidemark.llm import exact_dedup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_dedup.drop_copies(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [block for block in plan.split("\n\n") if ") Exchange" in block.split("\n")[0] and ("row#" in block or "content#" in block)]
    assert len(moved) == 3


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
