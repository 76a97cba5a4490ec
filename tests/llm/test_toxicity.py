import math
import random

import numpy as np

from skyloom.llm import toxicity as tx

LABELS = "doc_id long, toxic int"


def make(seed=1, n=600):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "the of in re on an er".split() for b in "st al or en ti".split()]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(["zorkface", "blargo" + r.choice(vocab)]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = make()
    rows += [(9000, None), (9001, ""), (None, "zorkface zorkface you")]
    got = tx.scores(docs(rows, 4), spark.createDataFrame(labels, LABELS)).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9000].predicted == 0 and by[9000].score == by[9001].score
    assert by[None].predicted == 1 and by[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_training_leaves_held_out_rows_alone(spark, docs):
    rows, labels = make(2, 300)
    import zlib

    flipped = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, t) for i, t in labels]
    a = tx.train(docs(rows), spark.createDataFrame(labels, LABELS))
    b = tx.train(docs(rows), spark.createDataFrame(flipped, LABELS))
    assert a == b


def test_clause_grammar():
    g = tx.Grammar({"scum": 2.0}, {"zork": 3.0})
    assert g.clause("you are scum".split()) == (2.0, 1, 1, 0, 0, 0)
    assert g.clause("not zorkish".split()) == (3.0, 1, 0, 1, 0, 0)
    assert g.clause("you are not scum".split()) == (2.0, 1, 1, 1, 0, 0)
    assert g.clause("i will never hurt you".split()) == (0.0, 0, 0, 0, 0, 0)
    assert g.clause("he said you scum".split()) == (2.0, 1, 1, 0, 1, 0)
    assert g.clause("i will kill you zork".split())[5] == 1
    f = dict(zip(tx.FEATURES, g.features("Scum! A zorkling. No insult here."), strict=True))
    assert f["clauses"] == f["variety"] == math.log1p(2)
    assert not g.features("scummy discum").any()  # a word is matched whole


def brute_clause(words, insults):
    """A clause read by the grammar's definition, place by place."""
    total, n, aimed, negated, reported, threats = 0.0, 0, 0, 0, 0, 0
    for i, w in enumerate(words):
        target = any(x in tx.TARGETS for k, x in enumerate(words) if k != i)
        before = words[max(i - tx.SCOPE, 0) : i]
        last = max((k for k, x in enumerate(before) if x in tx.NEGATIONS), default=None)
        no = last is not None and not any(x in tx.TARGETS for x in before[last + 1 :])
        if w in insults:
            total += insults[w]
            n += 1
            aimed += target
            negated += no
            reported += any(x in tx.REPORTS for x in before)
        elif w in tx.THREATS:
            threats += target and not no
    return total, n, aimed, negated, reported, threats


def test_readings_against_brute_force():
    r = random.Random(5)
    insults = {"scum": 2.0, "zork": 3.0, "blarg": 1.5}
    g = tx.Grammar(insults, {})
    words = ["scum", "zork", "blarg", "kill", "hurt", "you", "him", "not", "never", "said", "wrote", "a", "b", "c"]
    weights = [1, 1, 1, 1, 1, 0.4, 0.4, 1, 1, 1, 1, 3, 3, 3]
    for _ in range(3000):
        clause = r.choices(words, weights, k=r.randint(0, 14))
        assert g.clause(clause) == brute_clause(clause, insults), clause


def test_scores_against_brute_force(spark, docs):
    """Scores of whole texts from clauses that are cut and read by hand."""
    import math
    import re

    r = random.Random(6)
    insults = {"scum": 2.0, "zork": 3.0}
    vocab = ["scum", "zork", "kill", "you", "not", "said", *"abcdef"]
    rows = [(i, "".join(r.choice(vocab) + r.choice([" ", " ", " ", ". ", "! ", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(300, rows[0][1]), (301, None), (302, "you " + "a " * 50_000 + "scum")]
    model = tx.Model(insults, {}, [0.3, 0.2, 0.1, 0.4, 0.5, 0.6, -0.7, -0.8, 0.9, 0.25], -2.0)
    df = docs(rows).selectExpr("*", "1 score", "2 features", "3 toxic")
    got = {x.doc_id: x.score for x in tx.with_score(df, model).collect()}
    assert len(got) == len(rows) and got[300] == got[0]
    for i, t in rows:
        low = t or ""
        clauses = [brute_clause(re.findall("[a-z]+", c), insults) for c in re.split(r"[.!\n]+", low)]
        w, n, aimed, negated, reported, threats = (sum(c[k] for c in clauses) for k in range(6))
        kinds = len({x for x in re.findall("[a-z]+", low) if x in insults})
        l = math.log1p  # noqa: E741
        f = [l(n), l(w), min(n / max(len(low) / 6, 1) * 100, 10), l(sum(c[1] > 0 or c[5] > 0 for c in clauses)), n >= 2]
        f += [l(aimed), l(negated), l(reported), l(threats), l(kinds)]
        z = sum(a * b for a, b in zip(f, model.weights, strict=True)) + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


def test_composition():
    """The composed machine reads and writes what its parts do one after another."""
    plain = [tx.OTHER, tx.INSULT, tx.THREAT_TAG, tx.TARGET_TAG, tx.NEGATION_TAG, tx.REPORT_TAG]
    negated = plain + ["I-", "T-"]
    a, b = tx.scope("N", "-", plain, closes="G"), tx.scope("R", '"', negated)
    both, r = a.then(b), random.Random(7)
    for _ in range(300):
        tags = r.choices(plain, k=r.randint(0, 12))
        one = lambda x: [[(t, 0.0)] for t in x]
        assert both.read(one(tags)) == b.read(one(a.read(one(tags))))
    g = tx.clause_grammar()
    assert g.read([[("I", 1.0)], [("o", 0.0)], [("G", 0.0)]]) == ["I@", "o", "G"]
    assert g.read([[("T", 0.0)], [("o", 0.0)]]) == ["o", "o"]
    assert g.read([[("N", 0.0)], [("I", 1.0)], [("R", 0.0)], [("I", 1.0)]]) == ["N", "I-", "R", 'I-"']
    assert g.read([[("N", 0.0)], [("G", 0.0)], [("I", 1.0)]]) == ["N", "G", "I@"]  # the target ends the negation's scope


def test_repeated_rows(spark, docs):
    rows, labels = make(4, 200)
    df = docs(rows + rows[:50])
    twice = labels + labels[:50]
    got = {}
    for r in tx.scores(df, spark.createDataFrame(twice, LABELS)).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert all(len(got[i]) == 2 and len(set(got[i])) == 1 for i, _ in rows[:50])


def test_filter_keeps_columns_and_clean_documents(spark, docs):
    rows, labels = make(3, 300)
    df = docs(rows + [(500, None)]).selectExpr("*", "'mine' as score")
    out = tx.without_toxic(df, spark.createDataFrame(labels, LABELS))
    assert out.columns == df.columns and {r.score for r in out.collect()} == {"mine"}
    kept = {r.doc_id for r in out.collect()}
    assert 500 in kept and sum(t == 0 and i in kept for i, t in labels) >= 0.99 * sum(t == 0 for _, t in labels)
    assert sum(t == 1 and i in kept for i, t in labels) <= 0.05 * sum(t for _, t in labels)


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in tx.scores(docs([(1, "a")]), none).collect()] == [0]
    assert tx.scores(docs([]), none).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None)], LABELS)
    assert tx.scores(docs([(1, "a")]), nulls).count() == 1


def test_a_threat_at_a_target_is_a_match_without_an_insult(spark, docs):
    for g in (tx.Grammar({}, {}), tx.Grammar({"scum": 2.0}, {"zork": 3.0})):
        f = dict(zip(tx.FEATURES, g.features("Nothing here. I will kill you! They burn wood."), strict=True))
        assert f["threats"] == f["clauses"] == math.log1p(2) and f["insults"] == f["variety"] == 0
        assert not g.features("Killing time. To burn wood.").any()  # another word; no target
    f = dict(zip(tx.FEATURES, g.features("to burn wood, scum"), strict=True))
    assert f["clauses"] == f["variety"] == math.log1p(1) and f["threats"] == 0
    model = tx.Model({}, {}, [float(x == "threats") * 9 for x in tx.FEATURES], -3.0)
    got = {r.doc_id: r.score for r in tx.with_score(docs([(1, "I will kill you"), (2, ""), (3, "I will greet you")]), model).collect()}
    assert got[1] > 0.9 and got[2] == got[3] < 0.1


def test_long_clauses_are_read_from_their_start():
    g = tx.Grammar({"scum": 2.0}, {})
    far = " ".join(["word"] * 2000)
    for text in (f"You {far} scum", f"Other. You {far} scum", f"Scum! You {far} scum and scum; end"):
        f = dict(zip(tx.FEATURES, g.features(text), strict=True))
        assert f["aimed"] == math.log1p(text.count(" scum"))
    f = dict(zip(tx.FEATURES, g.features(f"You kill {far} scum"), strict=True))
    assert f["threats"] == math.log1p(1) and f["aimed"] == math.log1p(1)
    f = dict(zip(tx.FEATURES, g.features(f"You. {far} scum"), strict=True))
    assert f["aimed"] == 0  # the target stands in another clause
