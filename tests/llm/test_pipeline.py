"""The pipeline's stages on planted documents."""

import random

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(55)
    rows, marks = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = say(80) + "\n" + (passage if i % 10 == 1 else say(30)) + (" vileword nastyword vileword" if toxic else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        marks.append((i, 1, int(toxic)))
    copy = rows[7][1].split(" ")
    copy[3], copy[-3] = "changed", "changed"
    rows += [(301, " ".join(copy), "en", "s1", 0), (302, None, None, None, None), (303, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert tuple(docs.columns) == pipeline.COLUMNS
    kept = set(seen["toxicity"]["doc_id"])
    assert kept == {i for i in range(304) if i != 300 and (i % 6 or i > 300) or i == 303} - {300}
    lines = seen["line_dedup"].set_index("doc_id")
    assert len(lines) == len(kept) and sum(passage in (t or "") for t in lines["text"]) == 1
    assert lines.loc[303, "text"] == "" and lines.loc[302, "text"] is None
    one = set(seen["jaccard_join"]["doc_id"])
    assert kept - one == {301}
    assert seen["mixing"]["doc_id"].isin(one).all() and seen["mixing"].groupby("doc_id").size().max() <= 3
    packed = seen["packing"]
    assert packed["length"].sum() == packed.drop_duplicates(["doc_id", "sequence_id"])["length"].sum() and packed["sequence_id"].is_unique
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, cluster long, n_lines long"


def odd(spark):
    """Repeated ids with equal, near and unrelated texts; null ids, texts and sources; a very long text; ties; clashing names."""
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = say(60), say(60), say(60)
    near = a.replace(a.split(" ")[20], "changed")
    rows = [(1, a), (1, a), (1, b), (2, near), (3, b), (None, c), (None, c), (None, a), (4, c), (None, say(40)), (5, ""), (5, ""), (None, None), (6, None), (7, "one two"), (8, "ONE  two"), (9, "word " * 60_000)]
    return spark.createDataFrame([(i, t, None, None if i == 9 else "s", 0, "p", 1, 2) for i, t in rows], SCHEMA), (a, b, c)


def test_near_duplicate_stage_on_odd_rows(spark):
    docs, (a, b, c) = odd(spark)
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()))
    assert [t for _, i, t in kept if i == 1] == sorted([a, b])  # one id, unrelated texts: both stay, the repeat goes
    assert not [i for _, i, _ in kept if i in (2, 3, 8)] and [t for _, i, t in kept if i == 4] == [c]
    assert [t for _, i, t in kept if i == 7] == ["one two"] and sum(i == 5 for _, i, _ in kept) == 2
    assert sorted(len(t) > 0 for none, _, t in kept if none) == [False, True]  # of rows without id: the null text and the text of its own


def test_stages_keep_odd_rows_and_empty_tables(spark, tmp_path):
    docs, _ = odd(spark)
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert got.count() >= docs.count()
        else:
            assert tuple(got.columns) == pipeline.COLUMNS and got.count() > 0
        if name == "line_dedup":
            assert got.count() == docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
