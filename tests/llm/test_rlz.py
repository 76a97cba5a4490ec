import hashlib
import random
import re

import numpy as np

from skyloom.llm import rlz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """Kept words by trying every window against every earlier one."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            seen[k] = min(seen.get(k, (i, p)), (i, p))
    out = {}
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["a", "b", "é", "the", "日本"] + [f"w{i}" for i in range(200)]
    passages = [[r.choice(vocab) for _ in range(r.randint(18, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(1, 40))]
            if r.random() < 0.2:
                w += ["x", "y."] * r.randint(1, 40)
        rows.append((i * 3, "".join(x + r.choice([" ", "\n", "\t ", " "]) for x in w)))
    return rows + [(500, rows[3][1]), (501, rows[3][1]), (1000, None), (1001, ""), (1002, "  \n")]


def test_matches_brute_force(spark, docs):
    for seed in range(3):
        rows = corpus(seed)
        got = rlz.dedup(docs(rows, 5).select("doc_id", "text"), digest=True).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows)


def test_small_blocks_and_sources(spark, docs):
    rows = corpus(9)
    df = docs(rows, 4)
    found = rlz.spans(
        df.where("text is not null").selectExpr("doc_id", "xxhash64(text) text_hash", "text"), block_bytes=500
    ).collect()
    words = {i: WORD.findall(t or "") for i, t in rows}
    assert found
    for r in found:
        assert (r.src_doc, r.src_start) < (r.doc_id, r.start)
        n = r.windows + 19
        assert words[r.doc_id][r.start : r.start + n] == words[r.src_doc][r.src_start : r.src_start + n]


def test_greedy_parse(spark, docs):
    """Factors don't overlap, equal their sources, are longest, and reach across boundaries."""
    rows = corpus(4)
    words = {i: WORD.findall(t or "") for i, t in rows}
    by = {}
    for r in rlz.parse(docs(rows, 4)).collect():
        assert (r.src_doc, r.src_start) < (r.doc_id, r.start)
        assert words[r.doc_id][r.start : r.start + r.length] == words[r.src_doc][r.src_start : r.src_start + r.length]
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    want = brute(rows)
    assert {i: sum(n for _, n in x) for i, x in by.items()} == {i: x[1] for i, x in want.items() if x[1]}
    for own in by.values():
        own.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:], strict=False))


def test_factors():
    # Two matches that overlap: the second factor is what is left of a match across the boundary.
    assert rlz.factors([(0, 6, 1, 100), (4, 3, 2, 50)], 20) == [(0, 25, 1, 100), (25, 1, 2, 71)]
    # Runs in one source are one match.
    assert rlz.factors([(0, 5, 1, 7), (5, 4, 1, 12)], 20) == [(0, 28, 1, 7)]
    assert rlz.factors([(3, 1, 1, 0), (40, 1, 1, 9)], 20) == [(3, 20, 1, 0), (40, 20, 1, 9)]


def test_long_texts_are_cut_into_parts(spark, docs):
    r = random.Random(6)
    p = [f"p{i}" for i in range(40)]
    w = [f"w{r.randrange(300)}" for _ in range(3000)]
    rows = [(1, " ".join(w[:1000] + p + w[1000:])), (2, "\n".join(p)), (3, " ".join(w[990:1010])), (4, "x" * 5000 + " " + " ".join(w[:30]))]
    keyed = docs(rows, 1).selectExpr("doc_id", "xxhash64(text) text_hash", "text")
    for block in (300, 2000):
        got = {}
        for x in rlz.spans(keyed, block_bytes=block).collect():
            got.setdefault(x.doc_id, set()).update(range(x.start, x.start + x.windows + 19))
        want = brute(rows)
        assert {i: len(x) for i, x in got.items()} == {i: x[1] for i, x in want.items() if x[1]}


def test_a_phrase_in_many_contexts_makes_no_large_key(spark, docs, monkeypatch):
    """Anchors found to be heavy have their windows keyed by their own hashes; the result is the same."""
    import pyarrow as pa

    monkeypatch.setattr(rlz, "SAMPLE", 2)
    monkeypatch.setattr(rlz, "LEAST", 50)
    r = random.Random(7)
    phrase = [f"c{i}" for i in range(15)]
    vocab = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(r.choices(vocab, k=25) + phrase + r.choices(vocab, k=25))) for i in range(2000)]
    rows += [(3000 + i, rows[i][1]) for i in range(50)]
    df = docs(rows, 4)
    keyed = df.selectExpr("doc_id", "xxhash64(text) text_hash", "text")
    heavy = rlz.heavy_anchors(keyed, 20, 8)
    assert 1 <= len(heavy) <= 8
    texts = pa.array([t for _, t in rows[:2000]], pa.large_string())
    ids, zeros = np.arange(2000), np.zeros(2000, np.int64)
    for own, least, most in ((heavy[:0], 1000, 3000), (heavy, 1, 20)):
        keys = rlz.block_index(ids, zeros, zeros, texts, 20, 8, own)[1]["key"]
        assert least <= np.unique(keys, return_counts=True)[1].max() <= most
    got = rlz.dedup(df.select("doc_id", "text"), digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows)


def test_matching_a_few_rows_at_a_time(monkeypatch):
    """What is held is bounded, and a key's rows stay together."""
    import pyarrow as pa

    monkeypatch.setattr(rlz, "MATCH_ROWS", 3)
    key = np.sort(np.array([1, 1, 2, 3, 3, 3, 3, 4, 5, 5, 6, 7, 7, 7, 7, 7]))
    n = len(key)
    cols = {"key": key, "doc_id": np.arange(n)[::-1].copy(), "text_hash": key * 0, "place": (np.arange(n) << 6) | 3, "src_doc": key * 0, "src_start": key * 0}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()} | {"payload": pa.array([b"abcde"] * n)})
    for size in (1, 2, 5, 100):
        found = [x for b in rlz._match()(batch.slice(a, size) for a in range(0, n, size)) for x in b.to_pylist()]
        assert len(found) == n - len(set(key)) and all(x["src_doc"] < x["doc_id"] for x in found)


def test_texts_ties_and_extra_columns(spark, docs):
    p = " ".join(f"v{i}" for i in range(30))
    rows = [(1, p), (1, p), (None, "zz " + p), (2, "own words " + p + " tail"), (3, None)]
    df = docs(rows).selectExpr("*", "'x' as n_words", "7 as row", "8 as found")
    got = sorted(rlz.dedup(df).collect(), key=lambda r: (r.doc_id or -1, r.text or ""))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text == "zz " + p  # null ids come first
    assert [r.n_removed for r in by[1]] == [30, 30]
    assert by[2][0].text == "own words tail" and by[2][0].n_words == 33
    assert by[3][0].text is None and by[3][0].n_words == 0
    assert by[2][0].row == 7 and by[2][0].found == 8
    assert rlz.dedup(docs([])).count() == 0


def test_repeated_rows_without_earlier_copy_stay(spark, docs):
    p = " ".join(f"v{i}" for i in range(30))
    assert [r.n_removed for r in rlz.dedup(docs([(1, p), (1, p)])).collect()] == [0, 0]
