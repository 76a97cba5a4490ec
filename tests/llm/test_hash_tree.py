import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skyloom.llm import hash_tree
from skyloom.llm.hash_tree import HashTree


def brute(key, tree):
    """Descend the tree row by row."""

    def draw(node):
        u = (int(hashlib.md5(f"{key}|{node.name}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        return -math.log(u) / node.load

    nodes = tree.regions
    for _ in range(3):
        best = min(nodes, key=draw)
        nodes = best.children
    return tree.shards().index(best.name)


def shards(spark, tree, n=4000):
    df = spark.range(n).select(tree.shard_of(F.col("id")).alias("s"), "id")
    return {r.id: r.s for r in df.collect()}


def test_matches_descent_by_rows(spark):
    tree = HashTree.balanced(3, 2, 3).reweighted("r1/k0/s1", 2.5).grown()
    got = shards(spark, tree, 500)
    assert got == {i: brute(i, tree) for i in range(500)}


def test_a_new_shard_takes_rows_only_into_itself(spark):
    tree = HashTree.balanced(4, 5, 2)
    a, b, c = (shards(spark, t) for t in (tree, tree.grown(), tree.grown().grown()))
    moved = [i for i in a if a[i] != b[i]]
    assert moved and all(b[i] == 40 for i in moved)
    assert all(c[i] == 41 for i in b if b[i] != c[i])
    assert abs(len(moved) - 4000 / 41) < 5 * math.sqrt(4000 / 41)
    counts = Counter(a.values())
    assert len(counts) == 40 and all(abs(n - 100) < 60 for n in counts.values())


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    tree = HashTree.balanced(3, 3, 3)
    a, b = shards(spark, tree), shards(spark, tree.reweighted("r1/k1/s1", 0.2))
    names = tree.shards()
    for i in a:
        if a[i] != b[i]:
            # A row leaves the shard's own rack, region or the shard itself, never another region for another.
            assert names[a[i]].startswith("r1")


def test_report(spark, docs):
    rows = [(i, "x" * (i % 7) + "é") for i in range(300)] + [(5, "again"), (5, "again"), (None, None)]
    got = hash_tree.shard_report(docs(rows), HashTree.balanced(4, 5, 2), slot_parts=4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) in [(len(t.encode()) + 16, zlib.crc32(t.encode())) for t in text[r.doc_id]]
        assert r.grown_shard in (r.shard, 40)
        assert r.shard == brute("null" if r.doc_id is None else r.doc_id, HashTree.balanced(4, 5, 2))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.shard_report(docs([]), HashTree.balanced(2, 2, 2)).count() == 0
