"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made on counts of pieces by length: at most ``capacity`` numbers, whatever
the size of the corpus. The large lengths go through a linear grouping scheme: sorted,
cut into groups with (nearly) equal numbers of pieces, and rounded up to their group's
largest, so that only a few sizes are left. Configurations of these few sizes are optimised by
column generation: the linear program over all configurations is solved with a knapsack that
prices new ones, its counts are rounded down, and what is left is filled greedily. Since few
sizes cost room by rounding, a greedy choice of configurations of many sizes is made as well, and
the plan with fewer sequences is taken. Then the actual lengths take the places of the rounded ones, and small pieces are
put into the fullest sequences that still hold them (best fit, longest first).

All of this works on runs of equal sequences, not on single ones, so time and memory on
the driver depend on the number of distinct lengths and groups alone.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import gapless_rank, materialize
from skyloom.llm.tokens import encoder


def fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` best, by a knapsack over reachable sums.

    Sizes are in descending order; of equal fills, the one with larger sizes wins.
    """
    reached: dict[int, tuple[int, int]] = {0: (-1, 0)}  # sum -> (size index, sum before)
    for k, size in enumerate(sizes):
        for _ in range(min(counts[k], room // size)):
            new = {s + size: (k, s) for s in reached if s + size <= room and s + size not in reached}
            if not new:
                break
            reached.update(new)
    at, used = max(reached), [0] * len(sizes)
    while at:
        k, at = reached[at]
        used[k] += 1
    return used


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count) into groups with nearly equal numbers of pieces, longest first.

    A length that outnumbers a group's share is cut between groups, so groups stay even.
    """
    total = sum(counts.values())
    share = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = []
    free = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not free:
                out.append([])
                free = share
            take = min(n, free)
            out[-1].append((length, take))
            n -= take
            free -= take
    # Groups that start with one length have one rounded size.
    merged: list[list[tuple[int, int]]] = []
    for g in out:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1].extend(g)
        else:
            merged.append(g)
    return merged


def greedy(sizes: list[int], left: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations one after another: the fullest that holds the largest size left, as often as the counts allow."""
    left, shapes = list(left), []
    for k in range(len(sizes)):
        while left[k]:
            left[k] -= 1
            rest = fullest(sizes[k:], left[k:], capacity - sizes[k])
            left[k] += 1
            use = [0] * k + rest
            use[k] += 1
            times = min(left[i] // u for i, u in enumerate(use) if u)
            shapes.append((use, times))
            for i, u in enumerate(use):
                left[i] -= u * times
    return shapes


def priciest(sizes: list[int], prices, capacity: int) -> list[int]:
    """The configuration of the greatest price, by an unbounded knapsack over the capacity."""
    import numpy as np

    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, size in enumerate(sizes):
        if prices[k] <= 0:
            continue
        for _ in range(capacity // size):
            new = best[:-size] + prices[k]
            better = np.flatnonzero(new > best[size:] + 1e-12)
            if not len(better):
                break
            best[size + better], last[size + better] = new[better], k
    # Walk back with the prices: a size fits at a sum if the sum before it had the rest of the price.
    use, at = [0] * len(sizes), int(best.argmax())
    while last[at] >= 0:
        k = last[at]
        use[k] += 1
        at -= sizes[k]
    return use


def column_generation(sizes: list[int], counts: list[int], capacity: int, rounds: int = 600) -> list[tuple[list[int], int]]:
    """Configurations of few sizes: the linear program's, rounded down, and greedy ones for what is left.

    The revised simplex method over configurations: a basis of as many configurations as sizes,
    the sizes' prices from it, and the priciest configuration as the next to enter.
    """
    import numpy as np

    m = len(sizes)
    if not m:
        return []
    need = np.array(counts, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        use = np.array(priciest(sizes, prices, capacity), float)
        if use @ prices <= 1 + 1e-7:
            break
        amounts, direction = np.linalg.solve(basis, need), np.linalg.solve(basis, use)
        ratio = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = use
    amounts = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(int)
    left, shapes = list(counts), []
    for j, times in enumerate(amounts.tolist()):
        use = [int(u) for u in basis[:, j].round()]
        times = min([times, *(left[i] // u for i, u in enumerate(use) if u)])
        if times:
            shapes.append((use, times))
            for i, u in enumerate(use):
                left[i] -= u * times
    return shapes + greedy(sizes, left, capacity)


#: Groups of large lengths for column generation, and for the greedy choice.
FEW, MANY = 48, 512


def plan(counts: dict[int, int], capacity: int, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first rank, number, first sequence, offset).

    The pieces of a length with ranks ``first rank`` .. + ``number`` go to successive
    sequences from ``first sequence``, each at ``offset``. Sequences are numbered from 0. The
    plan has at most a few runs for each length and configuration, however many pieces there are.
    """
    made = [planned(counts, capacity, FEW, small, column_generation), planned(counts, capacity, MANY, small, greedy)]
    return min(made, key=sequences)


def sequences(places: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + times for _, _, times, first, _ in places), default=0)


def planned(counts: dict[int, int], capacity: int, groups: int, small: int | None, solve) -> list[tuple[int, int, int, int, int]]:
    small = capacity // 5 if small is None else small
    counts = {length: n for length, n in counts.items() if n > 0}
    grouped = group_lengths({a: n for a, n in counts.items() if a > small}, groups)
    sizes, left = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    # Configurations of rounded sizes, each with the number of sequences that use it.
    shapes = solve(sizes, left, capacity)

    # Actual lengths for the rounded ones. A run is (room left, slots, sequences).
    queue = [list(reversed(g)) for g in grouped]  # the longest at the end
    runs: list[tuple[int, tuple[int, ...], int]] = []

    def substitute(slots: list[int], times: int, chosen: tuple[int, ...]) -> None:
        if not slots:
            runs.append((capacity - sum(chosen), chosen, times))
            return
        g = slots[0]
        while times:
            length, n = queue[g].pop()
            take = min(n, times)
            if n > take:
                queue[g].append((length, n - take))
            substitute(slots[1:], take, (*chosen, length))
            times -= take

    for use, times in shapes:
        substitute([i for i, u in enumerate(use) for _ in range(u)], times, ())

    # Small pieces by best fit, on runs keyed by the room that is left.
    open_runs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for room, slots, times in runs:
        open_runs[room].append((slots, times))
    rooms = sorted(open_runs)

    def put(room: int, slots: tuple[int, ...], times: int) -> None:
        if not open_runs[room]:
            i = bisect.bisect_left(rooms, room)
            if i == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        open_runs[room].append((slots, times))

    for length in sorted((a for a in counts if a <= small), reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                # As many new sequences as this length fills, and one for the rest.
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                    n %= each
                else:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                continue
            room = rooms[i]
            slots, times = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room]
                rooms.pop(i)
            if n >= times:
                fits = min(room // length, n // times)
                put(room - fits * length, (*slots, *(length,) * fits), times)
                n -= fits * times
            else:
                put(room - length, (*slots, length), n)
                put(room, slots, times - n)
                n = 0

    places, ranks, sequence = [], defaultdict(int), 0
    for room in sorted(open_runs):
        for slots, times in open_runs[room]:
            at = 0
            for length in slots:
                places.append((length, ranks[length], times, sequence, at))
                ranks[length] += times
                at += length
            sequence += times
    return places


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and end id, cut only beyond ``capacity``.

    Null texts count as empty and give one piece with the end id.
    """

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer)
        end = end_id.to_bytes(enc.width, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, dtype=enc.dtype).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    rows.append((doc_id, k, a, len(own), zlib.crc32(own.tobytes())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, parts: int = 64) -> DataFrame:
    """Every piece with its sequence_id and its offset there, gapless from 0.

    Null texts count as empty, null ids stay null, repeated rows are packed each, and an
    empty table gives no rows. Other columns are left out. Pieces of one length are
    numbered in ``parts`` parts, so a length that most documents share makes no large
    task; the plan and the parts' shifts are bounded by ``capacity`` and ``parts``.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = gapless_rank(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank", parts)
    # A length has many segments; keyed by (length, block of ranks), each row meets few of them.
    places = plan(counts, capacity)
    lengths = spark.sparkContext.broadcast(_segments(places))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        keys, sequences, offsets = lengths.value
        for batch in batches:
            key = batch.column("length").to_numpy(zero_copy_only=False) * 2**44 + batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, side="right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(sequences[at] + (key - keys[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(
                cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def _segments(places: list[tuple[int, int, int, int, int]]):
    """The plan as sorted arrays: key (length and first rank), first sequence, offset."""
    import numpy as np

    rows = np.array(sorted((a * 2**44 + r, s, o) for a, r, _, s, o in places), dtype=np.int64).reshape(-1, 3)
    return rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy()
