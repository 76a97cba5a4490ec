import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import packing
from skyloom.llm.queries import WORD_BPE


def check_plan(counts, places, capacity):
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, offset in places:
        ranks[length].append((first, n))
        for k in range(n):
            fill[sequence + k].append((offset, length))
    for length, n in counts.items():
        at = 0
        for first, k in sorted(ranks[length]):
            assert first == at
            at += k
        assert at == n
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(fill) == list(range(len(fill)))
    return len(fill)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_every_plan_is_valid(counts):
    for groups, solve in ((5, packing.column_generation), (5, packing.greedy), (40, packing.column_generation)):
        check_plan(counts, packing.planned(counts, 64, groups, None, solve), 64)
    n = check_plan(counts, packing.plan(counts, 64), 64)
    least = -(-sum(a * b for a, b in counts.items()) // 64)
    assert n >= least
    # no two sequences can both be at most half full
    assert n <= 2 * least + 1


def test_column_generation_solves_the_program():
    """Against all configurations: the rounded result is within one sequence a size of the least."""
    from itertools import product

    rng = random.Random(3)
    for _ in range(20):
        sizes = sorted(rng.sample(range(15, 60), 4), reverse=True)
        counts = [rng.randint(1, 400) for _ in sizes]
        shapes = packing.column_generation(sizes, counts, 100)
        assert [sum(u[i] * t for u, t in shapes) for i in range(4)] == counts
        assert all(sum(a * b for a, b in zip(u, sizes, strict=True)) <= 100 for u, _ in shapes)
        every = [c for c in product(range(7), repeat=4) if sum(a * b for a, b in zip(c, sizes, strict=True)) <= 100]
        # Weak duality, by prices that no configuration exceeds: a bound from below of any packing.
        best = 0.0
        for _ in range(400):
            y = np.array([rng.random() * s for s in sizes])
            best = max(best, float(y @ counts) / max(float(y @ c) for c in every))
        n = sum(t for _, t in shapes)
        assert best <= n + 1e-9
        # Prices in proportion to sizes are one such bound; the program's optimum lies between.
        use = packing.priciest(sizes, y, 100)
        assert abs(float(y @ use) - max(float(y @ c) for c in every)) < 1e-9


def test_the_plan_is_bounded_whatever_the_corpus():
    """Segments that are broadcast: their number hardly grows at a thousand times the pieces, and has a bound."""
    rng = np.random.default_rng(5)
    counts = {int(a): int(b) for a, b in zip(*np.unique(np.clip(rng.lognormal(6, 1.2, 50_000).astype(int), 1, 2048), return_counts=True), strict=True)}
    sizes = [len(packing.plan({a: b * k + k // 2 for a, b in counts.items()}, 2048)) for k in (1, 30, 1000)]
    assert sizes[2] < 3 * sizes[0] and max(sizes) < 40 * 2048


def test_close_to_the_bound_and_independent_of_scale():
    rng = np.random.default_rng(0)
    x = np.clip(rng.lognormal(6.2, 1.0, 200_000).astype(int), 1, 2048)
    counts = {int(a): int(b) for a, b in zip(*np.unique(x, return_counts=True), strict=True)}
    places = packing.plan(counts, 2048)
    n = check_plan(counts, places, 2048)
    assert n <= 1.003 * sum(a * b for a, b in counts.items()) / 2048
    assert len(packing.plan({a: 50 * b for a, b in counts.items()}, 2048)) < 2 * len(places)


def test_pack(spark, docs):
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma's", "déjà", "12", "...", "<|endoftext|>"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 900])))) for i in range(60)]
    rows += [(None, None), (7, rows[7][1]), (8, "")]
    ref = Tokenizer.from_file(WORD_BPE)
    capacity = 256
    want = []
    for i, t in rows:
        ids = [*ref.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[a : a + capacity], "<u4")
            want.append((i, k, a, len(own), zlib.crc32(own.tobytes())))
    got = packing.pack(docs(rows).selectExpr("*", "1 length", "2 rank", "3 piece"), WORD_BPE, 0, capacity, parts=3).collect()
    key = lambda x: str(x)
    assert sorted([tuple(x)[:5] for x in got], key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(docs([]), WORD_BPE, 0).count() == 0
