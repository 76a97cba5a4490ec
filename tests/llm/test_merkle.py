import hashlib
import random

from pyspark.sql import functions as F

from skyloom.llm import merkle


def brute(rows):
    """Edited texts and neighbours by sorting all rows."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 4
        out.append((d, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


def tree(text):
    """Sections, paragraphs and pieces of a text with their hashes, cut by hand."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sections = []
    for s in text.split("\n\n"):
        paragraphs = []
        for p in s.split("\n"):
            pieces, held = [], ""
            for i, c in enumerate(p):
                held += c
                if c in merkle.MARKS or (c in merkle.ENDS and p[i + 1 : i + 2] in (" ", "\t")):
                    pieces.append(held)
                    held = ""
            marks = [md5(x) for x in [*pieces, held] if x]
            paragraphs.append((md5("".join(marks)), [m[:8] for m in marks]))
        sections.append((md5("".join(h for h, _ in paragraphs)), paragraphs))
    return md5("".join(h for h, _ in sections)), sections


def brute_fingerprint(text):
    root, sections = tree(text)
    lines = [h[:10] + ":" + ";".join(x[:8] + ("." + ",".join(m) if m else "") for x, m in ps) for h, ps in sections]
    return root + "|" + "|".join(lines)


def brute_likeness(a, b):
    """Walk both trees; nodes are told apart by their short hashes."""
    if tree(a) == tree(b):
        return 1.0
    x, y = (dict.fromkeys((h[:10], tuple((q[:8], tuple(m)) for q, m in ps)) for h, ps in tree(t)[1]) for t in (a, b))
    weigh = lambda nodes: sum(len(m) for _, ps in nodes for _, m in ps)
    found = weigh(n for n in x if n in y)
    p, q = (dict.fromkeys(par for n in u if n not in v for par in n[1]) for u, v in ((x, y), (y, x)))
    found += sum(len(m) for h, m in p if (h, m) in q)
    found += len({m for n in p if n not in q for m in n[1]} & {m for n in q if n not in p for m in n[1]})
    return 2 * found / max(weigh(x) + weigh(y), 1)


def texts(n, seed=1):
    r = random.Random(seed)
    vocab = ["é", "日本", "of", "a\n", "b\n\n"] + [f"w{i}" for i in range(300)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(0, 90))) for _ in range(n)]


def test_edits_and_likeness(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    monkeypatch.setattr(merkle, "RANGES", 4)
    t = texts(120)
    rows = [(i * i * 1000, x) for i, x in enumerate(t)] + [(None, "no id"), (None, None), (9000, "tie"), (9000, "tie"), (10**17, t[5])]
    got = merkle.edit_report(docs(rows, 5)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(rows)
    by_id = {}
    for i, (d, x) in enumerate(rows):
        by_id.setdefault(d, []).append(x or "")
    order = sorted(d for d, x in by_id.items() if len(x) == 1 and d is not None)
    result = {r.doc_id: r for r in got}
    for d, after in zip(order, order[1:], strict=False):
        x, nxt = by_id[d][0], by_id[after][0]
        if d < 9000 < after or len(by_id.get(after, [])) > 1:
            continue
        cut = len(x) // 4
        edited = x[: len(x) - cut] + nxt[:cut]
        r = result[d]
        assert r.fingerprint == brute_fingerprint(x) and r.edited_fingerprint == brute_fingerprint(edited)
        assert abs(r.near_edited - brute_likeness(x, edited)) < 1e-12 and abs(r.near_next - brute_likeness(x, nxt)) < 1e-12
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    long = [r for r in got if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.5
    assert sum(r.near_next for r in long) / len(long) < 0.1


def test_an_inserted_word_changes_few_pieces(spark):
    r = random.Random(9)
    w = [f"w{r.randrange(10**6)}" for _ in range(400)]
    df = spark.createDataFrame([(" ".join(w), " ".join([*w[:7], "inserted", *w[7:]]))], "a string, b string")
    stored = spark.createDataFrame(df.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b")).collect(), "a string, b string")
    assert stored.select(merkle.likeness(F.col("a"), F.col("b")).alias("x")).first().x > 0.95


def test_far_ids_and_ids_of_many_rows_make_no_large_bucket(spark, docs):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(10**12, "far"), (10**17, "farther")]
    rows += [(None, f"no id {i}") for i in range(10_000)] + [(77, f"one id {i}") for i in range(5_000)]
    df = docs(rows).withColumn("text_hash", F.xxhash64("text"))
    made, follow = merkle.neighbour_buckets(df)
    sizes = [r["count"] for r in made.groupBy("__bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= merkle.HEAVY * merkle.BUCKET_ROWS
    held = made.select("__bucket", "doc_id", "text_hash").collect()
    key = lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.text_hash)
    assert [tuple(r["__bucket"]) for r in sorted(held, key=key)] == sorted(tuple(r["__bucket"]) for r in held)
    order = sorted({tuple(r["__bucket"]) for r in held})
    after = {tuple(r["__bucket"]): tuple(r["__to"]) for r in follow.collect()}
    assert after == {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}


def test_oracle(spark):
    import duckdb

    from skyloom.llm import queries

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    cols = con.sql(queries.OP5_SQL).columns
    want = sorted(con.sql(queries.OP5_SQL).fetchall())
    got = sorted(map(tuple, queries.op5_merkle_fingerprints(spark, "/root/testdata/sf0.01").select(*cols).collect()))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a - b) < 1e-12 for x, y in zip(got, want, strict=True) for a, b in zip(x[5:], y[5:], strict=True))


def test_roots_test_equality_and_branches_locate_edits(spark):
    pairs = [("a b c\nd e\n\nsecond part\n\nthird", "a b c\nd e\n\nsecond PART\n\nthird"), ("x\n\n\ny", "x\n\ny"), ("", "\n"), ("x ", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    got = df.select(a.alias("a"), b.alias("b"), merkle.fingerprint(F.col("a")).alias("c")).collect()
    assert all(r.a != r.b and r.a == r.c for r in got)
    stored = spark.createDataFrame(got, "a string, b string, c string")
    edits = [r.e for r in stored.select(merkle.edits(F.col("a"), F.col("b")).alias("e")).collect()]
    assert edits[0] == [1] and edits[3] == [0]


def test_all_texts_differ_in_their_roots(spark):
    t = sorted(set(texts(400, 2)))
    df = spark.createDataFrame([(x,) for x in t], "t string").select(F.substring(merkle.fingerprint(F.col("t")), 1, 32).alias("r"))
    assert df.distinct().count() == len(t)


def test_small_tables(spark, docs):
    assert merkle.edit_report(docs([])).count() == 0
    one = merkle.edit_report(docs([(5, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_plan_is_native(spark, docs):
    plan = merkle.edit_report(docs([(i, f"text {i}") for i in range(9)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
