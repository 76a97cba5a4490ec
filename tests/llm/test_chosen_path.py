import random

from skyloom.llm import chosen_path as cp


def brute(rows, k=5, t=0.8):
    """Links and classes by comparing all pairs of sets."""

    def shingles(text):
        w = (text or "").split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(x) for i, x in rows}
    distinct = sorted({s for s in sets.values() if s}, key=lambda s: min(i for i in sets if sets[i] == s))
    links = {s: [x for x in distinct if x != s and len(s & x) >= t * len(s | x) - 1e-9] for s in distinct}
    rep = {s: min(i for i in sets if sets[i] == s) for s in distinct}
    out = {}
    for i, s in sets.items():
        if not s:
            out[i] = (i, i, 0)
            continue
        seen, stack = {s}, [s]
        while stack:
            for x in links[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        out[i] = (rep[s], min(rep[x] for x in seen), len(links[s]))
    return out


def corpus(seed, n=30, family=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    line = [r.choice(vocab) for _ in range(12)]
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(3, 150))]
        if r.random() < 0.5:
            base = line + base
        for _ in range(r.randint(1, family)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    return rows + [(5000, ""), (5001, None), (5002, "one"), (5003, "one"), (5004, "one two")]


def test_matches_all_pairs(spark, docs):
    rows = corpus(1)
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in cp.link_classes(docs(rows, 4)).collect()}
    want = brute(rows)
    wrong = [i for i in want if want[i] != got[i]]
    assert len(got) == len(want) and not wrong
    assert sum(x[2] for x in want.values()) > 100


def test_large_family_and_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(cp, "NODE", 16)
    monkeypatch.setattr(cp, "BLOCK", 10)
    rows = corpus(2, n=3, family=60)
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in cp.link_classes(docs(rows, 4)).collect()}
    assert got == brute(rows)


def test_near_copies_make_few_edges(spark, docs, monkeypatch):
    """A large node of near copies is joined by stars; blocks of one leader don't meet."""
    monkeypatch.setattr(cp, "NODE", 16)
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    made = []
    plain = cp._dense_nodes
    monkeypatch.setattr(cp, "_dense_nodes", lambda led, t: made.append((led.count(), plain(led, t).cache())) or made[-1][1])
    got = cp.link_classes(docs(rows, 4)).collect()
    assert {x.class_id for x in got} == {0} and sum(x.n_links for x in got) == sum(x[2] for x in brute(rows).values())
    assert len(made) == 1  # such a node isn't split again
    for n, edges in made:
        assert 300 <= n and edges.count() <= 1.2 * n


def test_recall_of_runs():
    assert cp.runs_for(0.999) == 2
    assert (1 - cp.meeting_chance(0.8, cp.PICKS, cp.DEPTH)) ** cp.runs_for(0.999) <= 0.001


def test_null_ids_repeats_and_empty(spark, docs):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(None, text), (7, text), (7, text), (7, "other words here to make a second set"), (9, text + " more")]
    got = sorted(cp.link_classes(docs(rows)).collect(), key=lambda r: (r.doc_id or 0, r.n_links))
    assert [(r.doc_id, r.class_id, r.n_links) for r in got] == [
        (None, None, 1),
        (7, 7, 0),
        (7, None, 1),
        (7, None, 1),
        (9, None, 1),
    ]
    assert cp.link_classes(docs([])).count() == 0


def test_many_texts_under_one_id(spark, docs, monkeypatch):
    """Null ids with many different texts: each text is read once, by its hash, not once for every set."""
    monkeypatch.setattr(cp, "BLOCK", 10)
    rows = corpus(5, n=12, family=25)
    want = sorted(x[2] for x in brute(rows).values())
    read = []
    plain = cp._tokens
    counted = spark.sparkContext.accumulator(0)

    def tokens(k):
        inner = plain(k)

        def run(batches):
            for batch in inner(batches):
                counted.add(batch.num_rows)
                yield batch

        read.append(1)
        return run

    monkeypatch.setattr(cp, "_tokens", tokens)
    df = docs([(None, t) for _, t in rows] * 2).selectExpr("*", "1 size", "2 node", "3 family", "4 id", "5 sig1")
    got = sorted(r.n_links for r in cp.link_classes(df).collect())
    assert read and got == sorted(want * 2)
    assert counted.value <= len({t for _, t in rows})


def test_sizes_in_a_large_family(spark, docs, monkeypatch):
    """A chain from short to long texts is one family; links cross the bands of sizes."""
    monkeypatch.setattr(cp, "BLOCK", 6)
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[: 20 + 4 * i])) for i in range(90)]
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in cp.link_classes(docs(rows, 4)).collect()}
    assert got == brute(rows)


def test_other_thresholds(spark, docs):
    rows = corpus(6, n=12)
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in cp.link_classes(docs(rows, 4), threshold=0.7).collect()}
    assert got == brute(rows, t=0.7)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100) for _ in range(60)] + [(500, 500 + i) for i in range(30)]
    got = dict(cp.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61))
    assert all(got[b] == 100 for b, _ in edges if 100 <= b < 200)
    assert all(got[500 + i] == 500 for i in range(30))
