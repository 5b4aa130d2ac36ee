from pyspark.sql import functions as F

from cellweave.llm import oddsketch, shared, toxicity


def test_few_rows_are_left_and_none_is_lost(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    df = df.union(spark.createDataFrame([(None, "x"), (7, "again")], "doc_id long, text string"))
    for every in (3, 1000, 30_000):
        keys = shared.pin(df.where(f"doc_id % {every} = 0 and doc_id > 0").select("doc_id").distinct())
        want = df.join(keys, "doc_id", "left_semi")
        got = shared.join_few(df, keys, ["doc_id"], "left_semi")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        flagged = shared.maybe_in(df, F.xxhash64("doc_id"), keys.select(F.xxhash64("doc_id").alias("k")), "maybe")
        assert flagged.count() == df.count()
        assert flagged.where("maybe").count() <= want.count() + df.count() / 10


def moved(monkeypatch):
    """Rows that pass `maybe_in`, in the order of its calls, and how many there were."""
    seen, whole = [], shared.maybe_in

    def spy(df, key, keys, name):
        out = whole(df, key, keys, name)
        seen.append((out.where(F.col(name)).count(), out.count()))
        return out

    for module in (shared, oddsketch):
        monkeypatch.setattr(module, "maybe_in", spy)
    return seen


def test_texts_without_label_do_not_move(spark, monkeypatch):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id"), F.when(F.col("id") < 100, "vileword")).alias("text")
    )
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") < 100).cast("int").alias("toxic"))
    seen = moved(monkeypatch)
    assert toxicity.score(docs, labels).where("predicted = 1").count() == 100
    assert len(seen) == 2 and all(some < 0.2 * every for some, every in seen)


def test_texts_without_near_copies_do_not_move(spark, monkeypatch):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.md5(F.concat_ws("-", i, F.col("id") % 2000))), " ")
    docs = spark.range(2050).select(F.col("id").alias("doc_id"), F.concat(words, F.when(F.col("id") < 50, " end").otherwise("")).alias("text"), F.lit("x").alias("id"))
    seen = moved(monkeypatch)
    left = oddsketch.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == list(range(2000))
    assert len(seen) == 2 and all(some < 0.2 * every for some, every in seen)
