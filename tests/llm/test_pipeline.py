import random
import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.test_chosen_path import brute as classes
from tests.llm.test_rlz import brute as repeats


def corpus(seed=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(55)]
    rows, labels = [], []
    for i in range(150):
        w = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        toxic = i % 6 == 1
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["zorkface", "blargo"]))
        if i % 10 == 0:
            w[10:10] = passage
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
        if i % 9 == 0 and not toxic:
            w[3] = "other"
            rows.append((1000 + i, " ".join(w)))
    return rows + [(5000, None), (5001, "")], labels


def test_stages_against_brute_force(spark, docs, tmp_path):
    rows, labels = corpus()
    d = f"file://{tmp_path}/sf"
    docs(rows, 4).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    columns = table.columns

    clean = cp.drop_toxic(spark, table, d)
    assert clean.columns == columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    toxic = {i for i, t in labels if t}
    assert set(kept) == {i for i, _ in rows} - toxic

    one = cp.one_of_each_group(spark, clean, d)
    assert one.columns == columns
    left = {r.doc_id: r.text for r in one.collect()}
    want = {i for i, (_, name, _) in classes(list(kept.items())).items() if i == name}
    assert set(left) == want and len(left) < len(kept)

    cut = cp.drop_repeated_passages(spark, one, d)
    assert cut.columns == columns
    texts = {r.doc_id: r for r in cut.collect()}
    gone = repeats(list(left.items()))
    for i, r in texts.items():
        n, removed, _ = gone[i]
        assert len(re.findall(r"\S+", r.text or "")) == n - removed
        assert removed or r.text == left[i]
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert any(g[1] for g in gone.values())

    packed = cp.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(left)
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "packing"]


def test_repeated_rows_clashing_columns_and_empty_tables(spark, docs, tmp_path):
    """Every stage keeps the columns it is given, names of its own included, and takes repeats and empty tables."""
    rows, labels = corpus(3)
    rows = rows[:60] + rows[:10] + [(None, rows[2][1]), (None, None)]
    extra = ["1 score", "2 family", "3 size", "4 found", "5 n_words", "6 length", "7 node", "8 text_hash"]
    d = f"file://{tmp_path}/sf"
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    for table, empty in ((docs(rows, 3).selectExpr("*", *extra), False), (docs([]).selectExpr("*", *extra), True)):
        for _, stage in cp.STAGES[:3]:
            out = stage(spark, table, d)
            # n_words is what the stage of repeated passages counts; as an input column it is passed through
            assert out.columns == table.columns
            assert (out.count() == 0) == empty
            table = spark.createDataFrame(out.collect(), out.schema)
        assert (cp.pack_sequences(spark, table, d).count() == 0) == empty
