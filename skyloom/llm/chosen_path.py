"""Near-duplicate join of token n-gram sets by chosen paths.

Documents are sets of shingles (runs of ``k`` words). Sets split recursively: at a node,
every set picks, with the node's own hash, tokens of a sketch and follows each of them
to a child, so that two sets at the similarity threshold are expected to share more than
one child. Nodes with few sets are brute-forced; larger ones split again, unless most of their
sets are alike, which would stay together: these are compared through leaders. A pair of
similar sets may part at some node, so the descent is repeated in independent runs.

Each set's sketch is a row of min-hashes, one token per coordinate; a coordinate is
shared with probability J. A node picks ``picks`` coordinates, so at J = 0.8 a pair
shares 0.8 x picks of the children it could share. The chance to meet in one run after d
levels follows q(1) = 1 - (1 - J)^picks and q(d + 1) = 1 - (1 - J q(d))^picks, and
``runs`` is the least number for which 1 - (1 - q)^runs reaches the target recall.

1. Sets with equal shingles are one class, represented by the least doc_id.
2. Paths of all runs meet by key; what meets in a small node and has similar sketches is
   joined to a candidate family. Only tree edges are kept (a row a member), not pairs.
3. A family's shingles meet in pairs of blocks whose sizes allow links, and all similarities
   there are exact: common shingles are counted by a product of 0/1 matrices. Each block pair
   gives the links of its members and tree edges again, and these edges make the classes.

So no step emits the pairs of a group, links are counted for all of them, and a large
family is spread over block pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.common import NULL_ID, discard, id_key, materialize
from skyloom.llm.words import SEEDS, Words, mix

K, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Coordinates of a sketch, coordinates picked at a node, and levels of the descent at most.
WIDTH, PICKS, DEPTH = 64, 3, 3
#: Sets in a node that are compared at once, sets in a block of a family, and rows that a task compares at a time.
NODE, BLOCK, ROWS = 1024, 512, 8192
#: Sets of a large node that all others are compared with first, at most.
LEADERS = 32


def slack(threshold: float) -> float:
    """A sketch agrees in WIDTH x J places on average; pairs this far below the threshold (five
    standard deviations) aren't candidates."""
    return 5 * math.sqrt(threshold * (1 - threshold) / WIDTH)


def meeting_chance(j: float, picks: int, depth: int) -> float:
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - j * q) ** picks
    return q


def runs_for(recall: float, j: float = THRESHOLD, picks: int = PICKS, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(j, picks, depth)))


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text of an Arrow array, ascending."""
    w = Words(texts)
    grams, n, out = w.runs(k, 4), w.counts(), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            # fewer than k words: the whole text is its one shingle
            out.append(mix(np.add.reduce(w.hash[a:b] * SEEDS[40 : 40 + b - a], keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(own):
        return 0, 0
    return int(np.add.reduce(mix(own)).view(np.int64)), int(np.bitwise_xor.reduce(mix(own * SEEDS[63])).view(np.int64))


def min_hashes(own: np.ndarray, width: int) -> bytes:
    low = np.full(width, 2**64 - 1, np.uint64)
    for c in range(0, len(own), 4096):
        x = own[None, c : c + 4096] * SEEDS[:width, None]
        np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=1), out=low)
    return (mix(low) >> np.uint64(32)).astype(np.uint32).tobytes() if len(own) else b""


def _sketch(k: int, width: int):
    """Size, signature and min-hashes of every text's shingle set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column("text"), k)
                sigs = [signature(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(x) for x in sets], pa.int32()),
                        pa.array([x for x, _ in sigs], pa.int64()),
                        pa.array([y for _, y in sigs], pa.int64()),
                        pa.array([min_hashes(x, width) for x in sets], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "size", "sig1", "sig2", "sketch"],
                )

    return run


def _tokens(k: int):
    """Shingle sets of texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = pa.array([x.tobytes() for x in shingle_sets(part.column("text"), k)], pa.binary())
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), tokens], [*names, "tokens"])

    return run


#: The block pairs that a set takes part in.
PAIRS = "array<struct<lo:int,i:int,hi:int,j:int,side:int>>"
SETS = "doc_id long, text_hash long, size int, sig1 long, sig2 long, sketch binary"


def _child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(node ^ mix(coordinate * SEEDS[61] + value.astype(np.uint64) * SEEDS[62]))


def _picks(node: np.ndarray, picks: int, width: int) -> np.ndarray:
    """The coordinates that a node picks: the first ``picks`` different ones of a hash sequence."""
    step = (mix(node ^ SEEDS[59]) % np.uint64(width // 2)) * np.uint64(2) + np.uint64(1)
    first = mix(node ^ SEEDS[60]) % np.uint64(width)
    return (first[:, None] + step[:, None] * np.arange(picks, dtype=np.uint64)) % np.uint64(width)


def _descend(runs: int, picks: int, width: int):
    """Children of the nodes in ``node`` (or of the roots, where it's null) for every set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, width)
            n = len(sketch)
            if "node" in batch.schema.names:
                row = np.arange(n)
                node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                row = np.repeat(np.arange(n), runs)
                node = np.tile(mix(np.arange(1, runs + 1, dtype=np.uint64)), n)
            c = _picks(node, picks, width)
            value = sketch[row[:, None], c.astype(np.int64)]
            child = _child(node[:, None], c, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(child.ravel().view(np.int64)), batch.column("doc_id").take(pa.array(np.repeat(row, picks)))],
                ["node", "doc_id"],
            )

    return run


def tree_edges(ids: np.ndarray, similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric 0/1 matrix connects: a member to its component's least id."""
    n = len(ids)
    if n == 2:
        return [(int(ids.min()), int(ids.max()))] if similar[0, 1] else []
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        for c in range(0, n, 512):
            new[c : c + 512] = np.minimum(label[c : c + 512], np.where(similar[c : c + 512], label, n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    by_least: dict[int, int] = {}
    for i in np.argsort(ids, kind="stable"):
        by_least.setdefault(int(label[i]), int(ids[i]))
    return [(by_least[int(label[i])], int(ids[i])) for i in range(n) if by_least[int(label[i])] != int(ids[i])]


def across(ids: np.ndarray, similar: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Edges between sides 1 and 2 that connect what ``similar`` connects, beyond what each side does by itself."""
    part = ids.copy()
    for s in (1, 2):
        own = np.flatnonzero(side == s)
        if len(own):
            root = {b: a for a, b in tree_edges(ids[own], similar[np.ix_(own, own)])}
            part[own] = [root.get(int(x), int(x)) for x in ids[own]]
    x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    i, j = np.nonzero(similar[np.ix_(x, y)])
    return [tuple(e) for e in np.unique(np.column_stack((part[x[i]], part[y[j]])), axis=0).tolist()]


def _compare(width: int, threshold: float):
    """Tree edges between sets of a node with similar sketches. Rows of a node are together.

    A pair of blocks (sides 1 and 2) gives edges across only: one for each pair of parts that
    is connected, where parts are what each block connects by itself.
    """
    least = (threshold - slack(threshold)) * width

    def run(batches):
        import pyarrow as pa

        names = ["a", "b"]
        held = None

        def out(edges):
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

        def groups(batch, last):
            node = batch["node"].to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True]))) if len(node) else np.array([0])
            ids, side = batch["doc_id"].to_numpy(), batch["side"].to_numpy()
            sketch = batch["sketch"].to_pylist()
            edges = []
            ends = cut[1:] if last else cut[1:-1]
            for a, b in zip(cut[:-1], ends, strict=False):
                if b - a < 2:
                    continue
                m = np.frombuffer(b"".join(sketch[a:b]), np.uint32).reshape(-1, width)
                if b - a <= 64:
                    same = (m[:, None, :] == m[None, :, :]).sum(axis=2)
                else:
                    same = np.zeros((b - a, b - a), np.int8)
                    for c in range(width):
                        same += m[:, c][:, None] == m[:, c][None, :]
                edges += tree_edges(ids[a:b], same >= least) if side[a] == 0 else across(ids[a:b], same >= least, side[a:b])
            return edges, 0 if last else int(cut[-2]) if len(cut) > 1 else 0

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= ROWS:
                edges, at = groups(held.combine_chunks(), False)
                yield from out(edges)
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield from out(groups(held.combine_chunks(), True)[0])

    return run


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(id, label) of every id in the edges (a, b): the least id that it is connected to.

    Rounds of large-star and small-star hooking: every id hangs its greater neighbours on
    its least neighbour, then all on the least. Edges stay as many as ids at most, and
    rounds are logarithmic. A hub's edges are pre-aggregated to one minimum a task.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = materialize(large.where("u < v").distinct(), "large-star")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .where("u < v")
            .union(least.select("v", F.col("m").alias("u")))
            .distinct()
        )
        new = materialize(small, "small-star")
        same = new.select(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        was = now.select(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(now, large)
        now = new
        if same == was:
            break
    roots = now.select(F.col("u").alias("id")).distinct()
    return now.select(F.col("v").alias("id"), F.col("u").alias(label)).union(roots.select("id", F.col("id").alias(label)))


def _verify(threshold: float):
    """Exact links in one pair of blocks (rows: id, side, tokens), and their tree edges.

    ``side`` is 0 for rows of the first block and 1 for the second. Links inside a block are
    counted in the pair of a block with itself only, whose rows all have side 0.
    """

    def run(key, table):
        import pyarrow as pa

        alone = key[1:3] == key[3:5]
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        size = np.array([len(s) for s in sets], np.float32)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Tokens of one set can't be common to two.
        number = np.cumsum(times > 1) - 1
        shared = times[column] > 1
        row, column = row[shared], number[column[shared]]
        by_column = np.argsort(column, kind="stable")
        row, column = row[by_column], column[by_column]
        x, y = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        common = np.zeros((len(x), len(y)), np.float32)
        total, step = int(number[-1]) + 1 if len(number) else 0, 4096
        for c in range(0, total, step):
            a, b = np.searchsorted(column, (c, c + step))
            m = np.zeros((len(sets), min(step, total - c)), np.float32)
            m[row[a:b], column[a:b] - c] = 1
            common += m[x] @ m[y].T
        union = size[x][:, None] + size[y][None, :] - common
        similar = common >= np.float32(threshold) * union - np.float32(1e-3)
        similar &= common.astype(np.float64) / np.maximum(union, 1) >= threshold - 1e-9
        links = np.zeros(len(ids), np.int64)
        if alone:
            np.fill_diagonal(similar, False)
            links += similar.sum(axis=1)
            full = similar
        else:
            links[x] += similar.sum(axis=1)
            links[y] += similar.sum(axis=0)
            full = np.zeros((len(ids), len(ids)), bool)
            full[np.ix_(x, y)] = similar
            full |= full.T
        root = {b: a for a, b in tree_edges(ids, full)}
        out_root = [root.get(int(d), int(d)) for d in ids]
        return pa.table({"id": pa.array(ids), "links": pa.array(links), "root": pa.array(out_root, pa.int64())})

    return run


def link_classes(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, rep_id, class_id and n_links of every document.

    ``rep_id`` is the least doc_id with the same set of shingles, ``n_links`` the number of
    different sets whose Jaccard similarity to the document's is at least ``threshold``,
    and ``class_id`` the least doc_id of all that links and equal sets connect.

    A text of fewer than ``k`` words has itself as its one shingle. Null and empty texts
    have no shingles: each document is a class of its own, without links. Rows that share
    an id have a set each; they are one class only if their sets are equal or linked. Null
    ids stay null and sort before all others. Repeated rows are equal sets: each is returned.
    Texts have any length, other columns are left out, and an empty table gives no rows.
    """
    texts = docs.select(id_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    sets = materialize(texts.mapInArrow(_sketch(k, WIDTH), SETS), "sets")
    full = sets.where("size > 0")
    # One task may meet a third of all rows with equal sets: the minimum is pre-aggregated.
    reps = full.groupBy("sig1", "sig2", "size").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("sketch").alias("sketch")
    )
    reps = reps.select("sig1", "sig2", "size", "sketch", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("text_hash"))
    # A set's id is its least doc_id; where rows with one doc_id have several sets, a hash tells these apart.
    several = F.count(F.lit(1)).over(Window.partitionBy("rep_id")) > 1
    reps = materialize(
        reps.withColumn("id", F.when(several, F.xxhash64("rep_id", "sig1", "sig2")).otherwise(F.col("rep_id"))), "reps"
    )
    sketches = reps.select(F.col("id").alias("doc_id"), "sketch")

    nodes = sketches.mapInArrow(_descend(runs_for(recall, threshold), PICKS, WIDTH), "node long, doc_id long").distinct()
    found = []
    for depth in range(1, DEPTH + 1):
        nodes = materialize(nodes, "nodes")
        size = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        size = materialize(size, "node-sizes")
        small, large = size.where(F.col("n") <= NODE), size.where(F.col("n") > NODE)
        found.append(_small_nodes(nodes.join(small.select("node"), "node").join(sketches, "doc_id"), threshold))
        if large.isEmpty():
            break
        led = _led(nodes.join(large, "node").join(sketches, "doc_id").select("node", "doc_id", "sketch", "n"), threshold)
        # A node most of whose sets are like a leader stays together however it is split: it is compared as it is.
        likely = F.col("attached") * 2 >= F.col("n") if depth < DEPTH else F.lit(True)
        counts = led.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count("leader").alias("attached"))
        dense = materialize(counts.select("node", likely.alias("dense")), "dense-nodes")
        found.append(_dense_nodes(led.join(dense.where("dense").select("node"), "node"), threshold))
        sparse = dense.where("not dense").select("node")
        if sparse.isEmpty():
            break
        nodes = led.join(sparse, "node").select("node", "doc_id", "sketch").mapInArrow(
            _descend(1, PICKS, WIDTH), "node long, doc_id long"
        ).distinct()
    edges = found[0]
    for e in found[1:]:
        edges = edges.union(e)
    family = materialize(components(edges, "family"), "families")

    members = family.join(reps, "id").select("id", "family", F.col("rep_id").alias("doc_id"), "text_hash", "size")
    links, tree = _exact(members, texts, k, threshold)
    classes = components(tree, "root")
    per_set = (
        reps.select("id", "rep_id", "sig1", "sig2", "size")
        .join(classes, "id", "left")
        .join(links, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    # A class is named by its least doc_id.
    named = per_set.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    per_set = per_set.join(named, "root").select(
        "sig1", "sig2", "size", "rep_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )
    out = full.select("doc_id", "sig1", "sig2", "size").join(per_set, ["sig1", "sig2", "size"])
    alone = sets.where("size = 0").select(
        "doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return out.select("doc_id", "rep_id", "class_id", "n_links").union(alone).select(
        *[F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) for c in ("doc_id", "rep_id", "class_id")], "n_links"
    )


def _leaders(threshold: float):
    """Every row's leader: the first of its node's whose sketch is similar, or null."""
    least = (threshold - slack(threshold)) * WIDTH

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(-1, WIDTH)
                node = part.column("node").to_numpy()
                leader, found = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                for x in np.unique(node):
                    rows = np.flatnonzero(node == x)
                    for one in part.column("leaders")[int(rows[0])].as_py():
                        sketch = np.frombuffer(one["sketch"], np.uint32)
                        left = rows[~found[rows]]
                        near = left[(own[left] == sketch).sum(axis=1) >= least]
                        leader[near], found[near] = one["doc_id"], True
                names = ["node", "doc_id", "sketch", "leader"]
                cols = [part.column(c) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(leader, mask=~found)], names)

    return run


def _small_nodes(here: DataFrame, threshold: float) -> DataFrame:
    """Tree edges of nodes of at most NODE sets: all are compared."""
    rows = here.select("node", "doc_id", "sketch", F.lit(0).alias("side"))
    return rows.repartition("node").sortWithinPartitions("node", "doc_id").mapInArrow(_compare(WIDTH, threshold), "a long, b long")


def _led(large: DataFrame, threshold: float) -> DataFrame:
    """node, doc_id, sketch and leader of large nodes' sets: each is compared with some leaders of its node."""
    picked = F.pmod(F.xxhash64("node", "doc_id"), F.greatest(F.ceil(F.col("n") / (LEADERS / 2)), F.lit(1))) == 0
    leaders = large.where(picked).groupBy("node").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("doc_id", "sketch"))), 1, LEADERS).alias("leaders")
    )
    led = large.join(leaders, "node", "left").select("node", "doc_id", "sketch", F.coalesce("leaders", F.array()).alias("leaders"))
    return materialize(led.mapInArrow(_leaders(threshold), "node long, doc_id long, sketch binary, leader long"), "led")


def _dense_nodes(led: DataFrame, threshold: float) -> DataFrame:
    """Tree edges of large nodes.

    An edge joins every set to its leader, the first similar one. Sets with one leader are
    connected by that and not compared with each other, so many near copies cost as many
    comparisons, not their square. Blocks of up to NODE sets are made of the sets of one
    leader where these fill blocks, and of all others; they are compared in pairs, but for two
    blocks of one leader.
    """
    stars = led.where("leader != doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))

    groups = led.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("g"))
    full = F.col("leader").isNotNull() & (F.col("g") > NODE)
    made = F.when(full, F.struct("leader", F.ceil(F.col("g") / NODE).cast("int").alias("blocks")))
    per_node = groups.groupBy("node").agg(
        F.ceil(F.coalesce(F.sum(F.when(~full, F.col("g"))), F.lit(0)) / NODE).cast("int").alias("mixed"),
        F.collect_list(made).alias("pure"),
    )
    rows = led.join(per_node, "node")
    mine = F.get(F.filter("pure", lambda p: p["leader"] == F.col("leader")), F.lit(0))["blocks"]
    own = F.when(mine.isNotNull(), F.struct(F.col("leader").alias("of"), F.pmod(F.xxhash64("doc_id"), mine).cast("int").alias("i")))
    own = F.coalesce(own, F.struct(F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("doc_id"), F.greatest(F.col("mixed"), F.lit(1))).cast("int").alias("i")))
    rows = rows.withColumn("own", own)
    # Blocks of others are numbered from 0 with a null leader; null sorts first, so own and other are put in order.
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = "array<struct<of:bigint,i:int>>"
    others = F.transform(numbers(F.col("mixed")), lambda i: F.struct(F.lit(None).cast("long").alias("of"), i.alias("i"))).cast(block)
    pures = F.flatten(
        F.transform(
            F.filter("pure", lambda p: ~p["leader"].eqNullSafe(F.col("own.of"))),
            lambda p: F.transform(numbers(p["blocks"]), lambda i: F.struct(p["leader"].alias("of"), i.alias("i"))),
        )
    ).cast(block)
    met = rows.select("node", "doc_id", "sketch", "own", F.explode(F.concat(others, pures)).alias("other"))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    pairs = met.select(
        F.xxhash64("node", first["of"], first["i"], second["of"], second["i"], F.isnull(first["of"]), F.isnull(second["of"])).alias("node"),
        "doc_id",
        "sketch",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == first, 1).otherwise(2).alias("side"),
    )
    compared = pairs.repartition("node").sortWithinPartitions("node", "doc_id").mapInArrow(
        _compare(WIDTH, threshold), "a long, b long"
    )
    return compared.union(stars)


def _exact(members: DataFrame, texts: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact links of every set, and tree edges of the links, from the families' shingles.

    Sets of a similarity ``t`` have sizes within a factor of 1 / t. So a family of more than
    one block is cut into bands of sizes by that factor, and only blocks of one band or of
    neighbouring bands meet. A text comes by its id and its hash, once however often it is
    repeated, so ids that many rows share (as null does) don't multiply.
    """
    own = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    step = math.log(1 / threshold) * (1 + 1e-9) if threshold < 1 else 1.0
    band = F.when(F.col("n") > BLOCK, F.floor(F.log(F.col("size").cast("double")) / step)).otherwise(0).cast("int")
    banded = members.join(own, "family").withColumn("band", band).drop("n", "size")
    sizes = banded.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # A family has few bands: one for each factor of 1 / t between its least and its greatest size.
    by_band = Window.partitionBy("family").orderBy("band")
    near = [
        F.when(f("band", 1).over(by_band) == F.col("band") + d, f("blocks", 1).over(by_band)).otherwise(0).alias(name)
        for f, d, name in ((F.lag, -1, "below"), (F.lead, 1, "above"))
    ]
    sizes = sizes.select("family", "band", "blocks", *near)
    wanted = banded.join(sizes, ["family", "band"])
    single = texts.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    sets = single.join(wanted, ["doc_id", "text_hash"]).select(
        "id", "family", "band", "blocks", "below", "above", "text"
    ).mapInArrow(
        _tokens(k), "id long, family long, band int, blocks int, below int, above int, tokens binary"
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")

    def pairs(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast(PAIRS))

    def pair(lo, i, hi, j, side):
        cols = zip((lo, i, hi, j, side), ("lo", "i", "hi", "j", "side"), strict=True)
        return F.struct(*[c.cast("int").alias(name) for c, name in cols])

    b, zero, one = F.col("band"), F.lit(0), F.lit(1)
    met = F.concat(
        pairs(F.col("blocks"), lambda x: pair(b, F.least(x, block), b, F.greatest(x, block), F.when(x < block, one).otherwise(zero))),
        pairs(F.col("above"), lambda x: pair(b, block, b + 1, x, zero)),
        pairs(F.col("below"), lambda x: pair(b - 1, x, b, block, one)),
    )
    placed = sets.select("id", "family", "tokens", F.explode(met).alias("p")).select("id", "family", "tokens", "p.*")
    checked = materialize(
        placed.groupBy("family", "lo", "i", "hi", "j").applyInArrow(_verify(threshold), "id long, links long, root long"), "links"
    )
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    return links, checked.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b"))

