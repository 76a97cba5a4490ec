import math
import random
from collections import Counter

from skyloom.llm import bm25


def brute(rows, queries, k):
    docs = [(i, Counter((t or "").split())) for i, t in rows]
    n = len(docs)
    mean = sum(sum(c.values()) for _, c in docs) / n
    df = Counter(x for _, c in docs for x in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in docs:
            dl, s = sum(c.values()), 0.0
            for x in set((text or "").split()):
                if c[x]:
                    s += math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * dl / mean))
            if s > 0:
                scores.append((-s, i))
        out[q] = sorted(scores)[:k]
    return out


def rows(seed, n=300):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    out = []
    for i in range(n):
        w = [r.choice(common) if r.random() < 0.6 else f"w{int(r.paretovariate(0.6))}" for _ in range(r.randint(1, 120))]
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, out[5][1])]


def test_exact_against_all_scores(spark, docs, monkeypatch):
    """Ids, ranks and six digits, over several shards and blocks of queries."""
    monkeypatch.setattr(bm25, "QUERY_WORDS", 300)  # several blocks of queries
    data = rows(1)
    df = docs(data, 4)
    got = {}
    for r in bm25.search(df, df.where("doc_id % 10 = 0").selectExpr("doc_id query_id", "text"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    want = brute(data, [x for x in data if x[0] % 10 == 0 and x[1]], 7)
    assert set(got) == set(want)
    for q, best in want.items():
        assert sorted(got[q]) == [(i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(best)]


def one_shard(data):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in data]), "text": pa.array([t for _, t in data])})
    made = list(bm25._build([batch]))
    assert len(made) == 1
    return bm25.Shard(made[0].column("shard")[0].as_py(), 60.0)


def test_ranges_below_the_threshold_are_skipped():
    """Block maxima leave documents unscored, and the best stay those of a full scan."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    # Topics with words of their own: a query's documents stand in few ranges.
    data = [(i, " ".join(f"t{i % 20}w{int(r.paretovariate(0.8))}" for _ in range(60))) for i in range(3000)]
    shard = one_shard(data)
    _, terms, _, _ = bm25.term_counts(pa.array([data[7][1]]))
    owner, weights = np.zeros(len(terms), int), np.ones(len(terms))
    some, every = bm25.Best(1, 5), bm25.Best(1, 3000)
    shard.search(owner, terms, weights, some, 0)
    assert shard.scored < 1000
    shard.scored = 0
    shard.search(owner, terms, weights, every, 0)
    assert list(some.doc[0]) == list(every.doc[0, :5]) and list(some.score[0]) == list(every.score[0, :5])
    assert every.doc[0, 0] == 7


def test_bounds_hold():
    """No document scores more than its range's sum of block maxima: a floor at the best score keeps it."""
    import numpy as np
    import pyarrow as pa

    data = rows(4, 1500)[:1500]
    shard = one_shard(data)
    for q in (3, 50, 700):
        _, terms, _, _ = bm25.term_counts(pa.array([data[q][1]]))
        owner, weights = np.zeros(len(terms), int), np.linspace(0.1, 3, len(terms))
        free = bm25.Best(1, 3)
        shard.search(owner, terms, weights, free, 0)
        held = bm25.Best(1, 3, np.array([free.score[0, 2]]))
        shard.search(owner, terms, weights, held, 0)
        assert list(held.doc[0]) == list(free.doc[0])


def test_few_documents_of_a_pivot_are_scored_exactly():
    """Float32 sums leave out most documents, also without a threshold to start with; close scores and ties stay apart."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(6)
    # Every document has the query's words; hundreds differ from the best in the sixth digit or not at all.
    words = [f"q{i}" for i in range(300)]
    data = [(i, " ".join(words[: 300 - i % 3 * (i % 200)] + ["x"] * (i % 7))) for i in range(1500)]
    r.shuffle(data)
    shard = one_shard(data)
    query = pa.array([" ".join(words)])
    _, terms, _, _ = bm25.term_counts(query)
    owner, weights = np.zeros(len(terms), int), np.linspace(1e-4, 2, len(terms))
    best, every = bm25.Best(1, 5), bm25.Best(1, 1500)
    shard.search(owner, terms, weights, best, 0)
    assert 5 <= shard.scored < 500
    shard.search(owner, terms, weights, every, 0)
    weight = dict(zip(terms.tolist(), weights, strict=True))
    _, doc_terms, tf, _ = bm25.term_counts(query)
    assert set(tf.tolist()) == {1} and len(doc_terms) == 300
    want = []
    for i, text in data:
        d, t, f, length = bm25.term_counts(pa.array([text]))
        norm = 1.2 * (0.25 + 0.75 * length[0] / 60.0)
        want.append((-round(math.fsum(weight.get(x, 0) * c * 2.2 / (c + norm) for x, c in zip(t.tolist(), f.tolist(), strict=True)), 6), i))
    want = sorted(x for x in want if x[0] < 0)
    assert list(zip(-best.score[0], best.doc[0], strict=True)) == want[:5]
    assert list(zip(-every.score[0], every.doc[0], strict=True))[: len(want)] == want
    assert (every.score[0, len(want) :] == -np.inf).all()


def test_ties_and_clashing_columns(spark, docs):
    """Equal texts tie and come in the order of their ids; columns named like the operator's own don't matter."""
    df = docs([(5, "a b"), (3, "a b"), (4, "a b"), (None, None), (6, "c " * 30_000)])
    df = df.selectExpr("doc_id", "text", "1 score", "2 rank", "3 term", "4 shard", "5 seed")
    q = df.where("doc_id in (3, 6)").selectExpr("doc_id query_id", "text", "7 idf", "8 block")
    got = [(r.query_id, r.rank, r.doc_id) for r in bm25.search(df, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(3, 1, 3), (3, 2, 4), (6, 1, 6)]


def test_oracle(spark):
    import duckdb

    from skyloom.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.OP4_SQL).fetchall()
    got = queries.op4_bm25_search(spark, sf).select("query_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty(spark, docs):
    q = docs([(1, "a")]).selectExpr("doc_id query_id", "text")
    assert bm25.search(docs([]), q).count() == 0
    assert bm25.search(docs([(1, "a")]), q.where("false")).count() == 0
    assert [tuple(r) for r in bm25.search(docs([(None, "a b"), (2, "b")]), q).collect()][0][:3] == (1, 1, None)
