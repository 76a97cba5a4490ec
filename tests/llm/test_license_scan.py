import random

from skyloom.llm import license_scan as ls


def brute(rows):
    """Containment of every template in every whole text."""
    out = set()
    for i, text in rows:
        w = ls.template_words(text or "")
        have = {tuple(w[k : k + ls.SHINGLE]) for k in range(len(w) - ls.SHINGLE + 1)}
        for name, t in ls.TEMPLATES.items():
            tw = ls.template_words(t)
            own = {tuple(tw[k : k + ls.SHINGLE]) for k in range(len(tw) - ls.SHINGLE + 1)}
            c = len(own & have) / len(own)
            if c >= ls.CONTAINMENT:
                out.add((i, name, round(c, 6)))
    drop = set(ls.superseded(ls.TEMPLATES))
    return {x for x in out if not any((x[1], y[1]) in drop for y in out if y[0] == x[0])}


def test_matches_brute_force(spark, docs):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + "the of license software any".split()
    rows = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 2)):
            t = r.choice(list(ls.TEMPLATES.values())).split()
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() if r.random() < 0.1 else x for x in t]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "released UNDER the mit license"), (903, "Released under the"), (None, "Released under the MIT License.")]
    got = ls.scan(docs(rows, 4)).collect()
    assert {(x.doc_id, x.license, x.containment) for x in got} == brute(rows)
    assert len(got) == len(brute(rows)) > 20
    by = {x.doc_id: x for x in got if x.doc_id in (902, None)}
    assert by[902].first_word == 0 and by[None].license == "MIT (notice)"


def test_repeats_clashing_columns_and_empty(spark, docs):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (1, "other text of five words")]
    df = docs(rows).selectExpr("*", "1 as w", "2 as at", "3 as license")
    assert [(x.doc_id, x.license) for x in ls.scan(df).collect()] == [(1, "CC-BY-NC-4.0 (notice)")]
    assert ls.scan(docs([])).count() == 0


def test_band_chance():
    most = 2 * ls.STRIDE - ls.SHINGLE + 1
    assert 1 - (1 - 1 / most) ** ls.BANDS > 0.9998


def test_the_most_specific_match(spark, docs):
    rows = [(1, ls.TEMPLATES["BSD-3-Clause"]), (2, ls.TEMPLATES["BSD-2-Clause"]), (3, ls.TEMPLATES["Apache-2.0"])]
    assert {(x.doc_id, x.license) for x in ls.scan(docs(rows)).collect()} == {(1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (3, "Apache-2.0")}
    long = [(4, "word " * 30_000 + ls.TEMPLATES["ISC"])]
    assert [(x.license, x.first_word) for x in ls.scan(docs(long)).collect()] == [("ISC", 30_000)]


def test_many_templates_are_not_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(ls, "BROADCAST_ROWS", 10)
    rows = [(1, "x y Licensed under CC BY-NC 4.0. z"), (2, "none of it here at all"), (3, ls.TEMPLATES["Zlib"])]
    out = ls.scan(docs(rows))
    assert "strategy=broadcast" not in out._jdf.queryExecution().logical().toString()
    assert {(x.doc_id, x.license) for x in out.collect()} == {(1, "CC-BY-NC-4.0 (notice)"), (3, "Zlib")}


def test_plan_is_native(spark, docs):
    plan = ls.scan(docs([(1, "a b c d e")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_templates_shorter_than_a_shingle(spark, docs):
    rows = [(1, "All rights reserved."), (2, " ".join(["x"] * 63) + "\nALL RIGHTS, reserved"), (3, "all rights are reserved"), (4, "rights")]
    rows += [(5, "Released under the MIT License. All rights reserved."), (6, None), (7, "reserved rights all")]
    got = {(x.doc_id, x.license, x.containment, x.first_word) for x in ls.scan(docs(rows)).collect()}
    short = "All rights reserved (notice)"
    assert got == {(1, short, 1.0, 0), (2, short, 1.0, 63), (5, short, 1.0, 5), (5, "MIT (notice)", 1.0, 0)}
    own = {"one": "Rights", "two": "all RIGHTS", "four": "all rights are reserved"}
    got = {(x.doc_id, x.license, x.first_word) for x in ls.scan(docs(rows), own).collect()}
    assert got == {
        *((i, "one", at) for i, at in ((1, 1), (2, 64), (3, 1), (4, 0), (5, 6), (7, 1))),
        *((i, "two", at) for i, at in ((1, 0), (2, 63), (3, 0), (5, 5))),
        (3, "four", 0),
    }
