"""Substring dedup by relative Lempel-Ziv parsing.

Every text is factored against all text before it in the order (doc_id, place). A factor
is a longest run of words that also stands earlier; factors of at least ``window`` words
are duplicate spans. The texts of a chunk form a reference block with an index of its
own; the blocks' indexes meet by key, so each text is factored against every block.

1. Index of a block. Each window of ``window`` words chooses an anchor, the least of its
   runs of ``anchor`` words by hash. Equal windows choose equal anchors at equal places.
   Inside a block, only the first of equal windows is kept; the others are answered on
   the spot. So a passage, however common, gives one row a block.
2. Matching. Rows with the same anchor meet, sorted by it, a bounded number at a time; windows
   that are equal (anchor hash of 64 bits, place, window hash of 40 bits) and not the first are
   answered with the first.
3. Parsing. Answers that go on in one source are joined to matches. From left to right, the
   match that reaches farthest is taken as the next factor, up to its end. The check at a
   factor's boundary: matches that begin before it and go on after it, whose windows lie across
   it, stay in play for the next factor, so no window is lost there.

Anchors that very many places share (a phrase of 8 to 19 words in many contexts) are found in a
sample of the documents. Their windows are keyed by their own hash, each in a row of its own,
so a phrase makes no large key. The sample decides where rows meet, not what is found.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import NULL_ID, id_key
from skyloom.llm.words import Words, mix, sliding_min

WINDOW, ANCHOR = 20, 8
#: Bytes of a window's hash in the index. It is compared only among windows with the same
#: anchor hash (64 bits) at the same place, so 40 bits make it 108.
HASH_BYTES = 5
#: Bytes of text in one reference block; the memory of a task is about 30 times this. Longer texts are cut, with an overlap.
BLOCK_BYTES = 5_000_000
#: Rows of the index that are matched at once (and those of one more key).
MATCH_ROWS = 200_000
#: One document of SAMPLE is looked at for heavy anchors; an anchor with LEAST places there is heavy. The HEAVY most
#: frequent are kept, so what is broadcast has at most 8 x HEAVY bytes, and no other key has more than a HEAVY-th of all rows.
SAMPLE, LEAST, HEAVY = 16, 128, 200_000
SPANS = "doc_id long, text_hash long, start int, windows int, src_doc long, src_start int"


def _runs(place: np.ndarray, *follow: np.ndarray) -> np.ndarray:
    """Where a new run begins: places that don't go on by one or values in ``follow`` that change."""
    new = np.ones(len(place), dtype=bool)
    if len(place) > 1:
        new[1:] = np.diff(place) != 1
        for f in follow:
            new[1:] |= f[1:] != f[:-1]
    return np.flatnonzero(new)


def _anchors(w: Words, window: int, anchor: int):
    """Places (among all words) where a window begins, of its anchor, and the hashes of all runs of ``anchor`` words."""
    n, total = w.counts(), len(w.hash)
    long_enough = np.flatnonzero(n >= window)
    if not len(long_enough):
        return None
    valid = np.zeros(total - window + 1, dtype=bool)
    step = np.zeros(total + 1, dtype=np.int32)
    np.add.at(step, w.first[long_enough], 1)
    np.add.at(step, w.first[long_enough] + n[long_enough] - window + 1, -1)
    valid = np.cumsum(step[:-1])[: len(valid)] > 0
    at = np.flatnonzero(valid)
    grams = w.runs(anchor, 2)
    if total >= 2**26:
        raise ValueError("a block has too many words for the packing of places")
    low = np.uint64(2**26 - 1)
    order = (mix(grams ^ np.uint64(0x5851F42D4C957F2D)) & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    return at, (sliding_min(order, window - anchor + 1) & low).astype(np.int64)[at], grams


def block_index(ids: np.ndarray, hashes: np.ndarray, base: np.ndarray, texts, window: int, anchor: int, heavy: np.ndarray):
    """Index rows and answers of one block. Texts come in ascending (doc_id, hash, base).

    ``base`` is the place of a text's first word, other than 0 for later parts of a long text;
    ``heavy`` has the anchors, ascending, whose windows have keys of their own.
    """
    w = Words(texts)
    found = _anchors(w, window, anchor)
    if found is None:
        return None
    at, chosen, grams = found
    win = w.runs(window, 0)
    text = np.searchsorted(w.first, at, side="right") - 1
    place = at - w.first[text] + base[text]
    # Equal windows of the block: the first in the order of texts and places answers the others.
    h = win[at]
    by = np.argsort(h, kind="stable")
    same = np.concatenate(([False], h[by][1:] == h[by][:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    source = np.empty(len(by), dtype=np.int64)
    source[by] = by[head]
    # Equal hashes of windows are checked word by word.
    copies = np.flatnonzero(source != np.arange(len(by)))
    for k in range(window):
        copies = copies[w.hash[at[copies] + k] == w.hash[at[source[copies]] + k]]
    kept = np.ones(len(by), bool)
    kept[copies] = False
    source[kept] = np.flatnonzero(kept)
    later = ~kept & ((ids[text] != ids[text[source]]) | (place != place[source]))
    answers = _spans(ids, hashes, text, place, np.flatnonzero(later), ids[text[source]], place[source])
    keep = np.flatnonzero(kept)
    alone = np.isin(grams[chosen[keep]], heavy)
    new = np.zeros(len(keep), bool)
    new[_runs(at[keep], chosen[keep])] = True
    begin = np.flatnonzero(new | alone)
    first, count = keep[begin], np.diff(np.append(begin, len(keep)))
    short = np.ascontiguousarray(h[keep]).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
    rows = {
        "key": np.where(alone[begin], mix(h[first]), grams[chosen[first]]).view(np.int64),
        "doc_id": ids[text[first]],
        "text_hash": hashes[text[first]],
        "place": (place[first] << 6) | (chosen[first] - at[first]),
        "ends": np.append(0, np.cumsum(count)) * HASH_BYTES,
        "windows": short,
    }
    return answers, rows


def _spans(ids, hashes, text, place, chosen, src_doc, src_start):
    """Answers of the chosen windows as runs that follow one source."""
    t, p, d, s = text[chosen], place[chosen], src_doc[chosen], src_start[chosen]
    begin = _runs(p, t, d, s - p) if len(p) else np.empty(0, np.int64)
    length = np.diff(np.append(begin, len(p)))
    return ids[t[begin]], hashes[t[begin]], p[begin], length, d[begin], s[begin]


def long_parts(text: str, block_bytes: int, window: int):
    """(place of the first word, part) of a long text's parts, each window whole in one of them."""
    import pyarrow as pa

    data, lo, base = text.encode(), 0, 0
    while True:
        hi = lo + block_bytes
        while hi < len(data) and not (data[hi] == 32 or 9 <= data[hi] <= 13):
            hi += 1  # to a word's end
        part = data[lo:hi].decode()
        yield base, part
        if hi >= len(data):
            return
        w = Words(pa.array([part]))
        step = len(w.begin) - window + 1
        if step <= 0:  # words so long that no window is whole: the part grows
            block_bytes *= 2
            continue
        lo, base = lo + int(w.begin[step]), base + step


def heavy_anchors(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    """Anchors that many places share, ascending; at most HEAVY."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                w = Words(batch.column("text").slice(a, 256))
                found = _anchors(w, window, anchor) if len(w.hash) < 2**26 else None
                if found is not None:
                    _, chosen, grams = found
                    key, n = np.unique(grams[np.unique(chosen)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "key").limit(HEAVY).select("key").toArrow()
    return np.sort(found["key"].to_numpy().view(np.uint64))


def _index(window: int, anchor: int, block_bytes: int, heavy):
    """Rows of the index (kind 0) and answers (kind 1) of a partition's blocks."""

    def emit(rows: dict | None, answers):
        import pyarrow as pa

        names = ["key", "doc_id", "text_hash", "place", "src_doc", "src_start", "payload"]
        types = [pa.int64()] * 6 + [pa.binary()]
        if rows is not None and len(rows["key"]):
            zeros = np.zeros(len(rows["key"]), np.int64)
            off = pa.py_buffer(rows["ends"].astype(np.int32).tobytes())
            payload = pa.Array.from_buffers(pa.binary(), len(zeros), [None, off, pa.py_buffer(rows["windows"])])
            cols = [rows["key"], rows["doc_id"], rows["text_hash"], rows["place"], zeros, zeros]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], payload], names)
        if answers is not None and len(answers[0]):
            ids, hashes, start, length, src, src_start = answers
            key = mix(ids.view(np.uint64) ^ start.astype(np.uint64)).view(np.int64)
            cols = [key, ids, hashes, start.astype(np.int64) << 32 | length, src, src_start]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(key), pa.binary())], names)

    def made(ids, hashes, base, texts):
        by = np.lexsort((base, hashes, ids))
        found = block_index(ids[by], hashes[by], base[by], texts.take(by), window, anchor, heavy.value)
        if found is not None:
            yield from emit(found[1], found[0])

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in table["text"].chunks])
            ids, hashes = table["doc_id"].to_numpy(), table["text_hash"].to_numpy()
            yield from made(ids, hashes, np.zeros(len(ids), np.int64), texts)

        for batch in batches:
            # a batch of Spark may be larger than a block, and a text as well
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                if part.nbytes > block_bytes:
                    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in part.column("text")])
                    for i in np.flatnonzero(sizes > block_bytes):
                        ids, hashes = (part.column(c).to_numpy()[i : i + 1] for c in ("doc_id", "text_hash"))
                        for base, piece in long_parts(part.column("text")[i].as_py(), block_bytes, window):
                            yield from made(ids, hashes, np.array([base]), pa.array([piece], pa.large_string()))
                    part = part.filter(pa.array(sizes <= block_bytes))
                held.append(part)
                size += part.nbytes
                if size >= block_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _match():
    """Answers for one partition of the index, which is sorted by key."""

    def out(cols):
        import pyarrow as pa

        names = ["doc_id", "text_hash", "start", "windows", "src_doc", "src_start"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches):
        import pyarrow as pa

        held, rows, last = [], 0, None
        for batch in batches:
            local = np.asarray(batch.column("payload").is_null())
            if local.any():
                own = batch.filter(pa.array(local))
                packed = own.column("place").to_numpy()
                yield out(
                    [
                        own.column("doc_id").to_numpy(),
                        own.column("text_hash").to_numpy(),
                        packed >> 32,
                        packed & 0xFFFFFFFF,
                        own.column("src_doc").to_numpy(),
                        own.column("src_start").to_numpy(),
                    ]
                )
            batch = batch.filter(pa.array(~local)).select(["key", "doc_id", "text_hash", "place", "payload"])
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if rows >= MATCH_ROWS:
                # What is held ends where its last key ends.
                end = int(np.searchsorted(key != last, True)) if key[0] == last else 0
                held.append(batch.slice(0, end))
                if end < len(key):
                    yield from matched(held)
                    held, rows, batch = [], 0, batch.slice(end)
                else:
                    continue
            held.append(batch)
            rows += batch.num_rows
            last = key[-1]
        if held:
            yield from matched(held)

    def matched(held):
        import pyarrow as pa

        table = pa.Table.from_batches(held)
        key = table["key"].to_numpy()
        # Most anchors stand in one row only: these go first.
        repeated = np.zeros(len(key), dtype=bool)
        same = key[1:] == key[:-1]
        repeated[1:] |= same
        repeated[:-1] |= same
        if not repeated.any():
            return
        table = table.filter(pa.array(repeated))
        key, ids, hashes, packed = (table[c].to_numpy() for c in ("key", "doc_id", "text_hash", "place"))
        start, offset = packed >> 6, packed & 63
        by = np.lexsort((start, hashes, ids))
        key, ids, hashes, start, offset = (x[by] for x in (key, ids, hashes, start, offset))
        payload = pa.concat_arrays([c.cast(pa.large_binary()) for c in table["payload"].chunks]).take(pa.array(by))
        _, off, data = payload.buffers()
        ends = np.frombuffer(off, np.int64)[payload.offset : payload.offset + len(by) + 1]
        count = np.diff(ends) // HASH_BYTES
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, HASH_BYTES)
        win = np.zeros((len(raw), 8), np.uint8)
        win[:, :HASH_BYTES] = raw
        row = np.repeat(np.arange(len(by)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        # The anchor's place in the window beside the window's hash.
        win[:, HASH_BYTES] = offset[row] - inner
        ident = win.view(np.uint64).ravel()
        k = key[row]
        order = np.lexsort((ident, k))  # stable: equal windows stay in the order of texts and places
        same = np.concatenate(([False], (ident[order][1:] == ident[order][:-1]) & (k[order][1:] == k[order][:-1])))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        source = np.empty(len(order), np.int64)
        source[order] = order[head]
        place = start[row] + inner
        later = (ids[row] != ids[row[source]]) | (place != place[source])
        yield out(_spans(ids, hashes, row, place, np.flatnonzero(later), ids[row[source]], place[source]))

    return run


def spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matched windows of (doc_id, text_hash, text) rows, as runs that follow one earlier source.

    ``windows`` windows from word ``start`` on also stand at ``src_doc`` from word
    ``src_start`` on. One shuffle, of index rows; texts stay where they are.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_anchors(docs, window, anchor))
    schema = "key long, doc_id long, text_hash long, place long, src_doc long, src_start long, payload binary"
    index = docs.mapInArrow(_index(window, anchor, block_bytes, heavy), schema)
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(_match(), SPANS)


def factors(answers: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one text: (first word, words, source's doc_id, source's first word) of its factors, in order.

    Answers are (start, windows, src_doc, src_start). Words outside of factors are literals.
    A factor that begins where the one before ends may be shorter than a window: it is the rest
    of a match whose windows lie across the boundary.
    """
    # Answers that go on in one source make one match: (start, end, source, source's start).
    matches: list[list[int]] = []
    for doc, shift, a, n in sorted((d, s - a, a, n) for a, n, d, s in answers):
        b = a + n - 1 + window
        if matches and matches[-1][2:] == [doc, shift] and a <= matches[-1][1] - window + 1:
            matches[-1][1] = max(matches[-1][1], b)
        else:
            matches.append([a, b, doc, shift])
    out, at, i = [], 0, 0
    matches.sort()
    best = None  # of the matches that have begun, the one that reaches farthest
    while True:
        while i < len(matches) and matches[i][0] <= at:
            if best is None or matches[i][1] > best[1]:
                best = matches[i]
            i += 1
        if best is not None and best[1] > at:
            out.append((at, best[1] - at, best[2], best[3] + at))
            at = best[1]
        elif i < len(matches):
            at = matches[i][0]
        else:
            return out


def _keep(window: int, digest: bool):
    """Drop covered words of every text; as a digest, or as the text that is left."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ns, gone, kept = [], [], []
            found = batch.column("found").to_pylist()
            texts = batch.column("text")
            w = Words(texts)
            for i, own in enumerate(found):
                a, b = w.first[i], w.first[i + 1]
                covered = factors([tuple(x.values()) for x in own], window) if own else []
                ns.append(int(b - a))
                gone.append(sum(n for _, n, _, _ in covered))
                keep = np.ones(b - a, dtype=bool)
                for x, n, _, _ in covered:
                    keep[x : x + n] = False
                words = [w.data[s:e].tobytes() for s, e in zip(w.begin[a:b][keep], w.end[a:b][keep], strict=True)] if digest or own else []
                if digest:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    kept.append(b" ".join(words).decode() if own else texts[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                schema=pa.schema(
                    [("row", batch.schema.field("row").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
                ),
            )

    return run


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, src_doc and src_start of every factor of every text (see :func:`factors`).

    Nulls, ties, repeated rows, empty tables and other columns as in :func:`dedup`.
    """
    schema = "doc_id long, start int, length int, src_doc long, src_start int"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [
                (doc, *x)
                for doc, own in zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist(), strict=True)
                for x in factors([tuple(y.values()) for y in own], window)
            ]
            names = ["doc_id", "start", "length", "src_doc", "src_start"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    found = _found(docs.select(id_key().alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), window)
    return found.select("doc_id", "found").mapInArrow(run, schema).select(
        null("doc_id"), "start", "length", null("src_doc"), "src_start"
    )


def _found(keyed: DataFrame, window: int) -> DataFrame:
    return (
        spans(keyed.where(F.col("text").isNotNull()).select("doc_id", "text_hash", "text"), window)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "windows", "src_doc", "src_start")).alias("found"))
    )


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """All columns of ``docs``, without the words that an earlier window covers.

    Adds n_words and n_removed. A word goes if a window of ``window`` words around it
    also starts earlier (at a smaller doc_id, or earlier in the same document), judged on
    the input. Texts that lose words become the kept words joined by one space, others
    stay unchanged; with ``digest`` the column kept_sha256 has the hash of the kept words
    joined by one space instead, and texts are left out.

    A null text has no words and stays null. Null ids count as one id before all others.
    Rows with the same id are one document: windows at the same place don't count as
    earlier. Texts have any length. An empty table gives no rows. Other columns are passed through
    unread, but columns named like the added ones are replaced by them.
    """
    keyed = docs.select(
        F.struct(*[c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_sha256")]).alias("row"), id_key().alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    found = _found(keyed, window)
    # A text is as often as its rows; equal rows of one id have equal spans, which merge.
    joined = keyed.join(found, ["doc_id", "text_hash"], "left").select("row", "text", "found")
    out = joined.mapInArrow(_keep(window, digest), _with_counts(joined))
    if digest:
        return out.select("row.*", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    cols = [
        F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c)
        for c in docs.columns
        if c not in ("n_words", "n_removed")
    ]
    return out.select(*cols, "n_words", "n_removed")


def _with_counts(joined: DataFrame):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    return StructType([joined.schema["row"], *added])
