"""Exact top-k search with BM25: block-max WAND over an inverted index in shards.

1. Index. Each block of documents becomes a shard: posting lists by term (gaps of document
   numbers, frequencies). Document numbers inside a shard are dealt so that alike documents
   are neighbours, and cut into ranges of at most ``RANGE`` documents where they stop to be alike.
   Number of documents, mean length and the document frequency of the
   queries' terms are global and exact, so scores of all shards can be compared.
2. Search. Posting lists are cut into blocks at the ranges' ends, and each block of each list
   has its greatest impact (block-max with blocks aligned by document). The cursors of a
   query's lists move from range to range: the sum of the block maxima of the lists that have
   a posting in the range is compared with the query's threshold, its k-th best score so far.
   A range that can't reach it is skipped, no posting of it is scored, and the next range that
   can is the pivot. Queries move in batches, each with cursors and a threshold of its own.
3. Pivots. The documents of a pivot are first scored in float32. All parts of a score are
   positive, so such a sum is off by a share of itself at most that the query's number of words
   bounds (``ROUNDING`` a word). Documents that can't reach the threshold by that are left out,
   the others are scored exactly, in float64 and term by term.
4. Thresholds. A query without one starts at its most promising range. They pass on from shard
   to shard of a task. Every ``SEED``-th shard is searched first, and the thresholds found there
   hold for all others, so that a shard returns only what can still be among the best.
5. Merge. The shards' best k of each query are merged; a document is in one shard only,
   so the merge is exact.

Lists with postings in more than ``FREQUENT`` of a range's documents are held as columns of the
range's matrix, others as lists; both have block maxima. All scores that are returned or
compared with each other are float64 and rounded to six digits. A document's words are those of
:mod:`skyloom.llm.words`, known by 64-bit hashes. A query counts each of its different words
once. Ties go to the lesser doc_id.
"""

from __future__ import annotations

import io
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.common import NULL_ID, id_key, materialize
from skyloom.llm.words import Words

K1, B = 1.2, 0.75
#: Documents and bytes of text in a shard, and documents in a range at most.
SHARD_DOCS, SHARD_BYTES, RANGE = 4096, 16_000_000, 1024
#: One shard of so many is searched first, for thresholds.
SEED = 8
#: Different words of all queries of a block: its memory on the driver and in a task is bounded by this and one query.
QUERY_WORDS = 2_000_000
#: Queries, and their words, that move together; queries that are scored, and documents that are scored exactly, at once.
BATCH, BATCH_WORDS, AT_ONCE, EXACT_AT_ONCE = 1024, 400_000, 256, 8
#: Terms in more than this share of a range's documents are frequent.
FREQUENT = 0.05
#: A posting costs about as much as so many cells of a matrix product.
MATRIX = 400
#: Scores are rounded to so many digits; a bound below a threshold by more than this can't reach it.
DIGITS, MARGIN = 6, 1e-6
#: A float32 sum of positive parts is off by less than this share of itself for each part, and for some steps more.
ROUNDING, STEPS = 2.0**-23, 8


def term_counts(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of all different words, by document, and the documents' lengths."""
    w = Words(texts)
    term, number = np.unique(w.hash, return_inverse=True)
    key = np.repeat(np.arange(len(w.first) - 1), w.counts()) * max(len(term), 1) + number
    key, tf = np.unique(key, return_counts=True)
    return key // max(len(term), 1), term[key % max(len(term), 1)], tf, w.counts()


def _alike(doc: np.ndarray, number: np.ndarray, terms: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of a shard's documents in which alike ones are neighbours, and the ends of its ranges.

    Documents are known by which of the shard's most frequent words they have. They are divided
    by their principal direction until a part has at most RANGE documents (so languages and
    topics stay together); parts are ordered by length.
    """
    n = len(lengths)
    count = np.bincount(number, minlength=terms)
    top = np.argsort(-count, kind="stable")[:256]
    column = np.full(terms, -1, np.int64)
    column[top] = np.arange(len(top))
    c = column[number]
    held = c >= 0
    seen = np.zeros((n, 256), np.float32)
    seen[doc[held], c[held]] = 1
    seen *= np.log1p(n / np.maximum(seen.sum(axis=0), 1))
    seen /= np.maximum(np.sqrt((seen * seen).sum(axis=1, keepdims=True)), 1e-6)
    parts, left = [], [np.arange(n)]
    while left:
        these = left.pop()
        if len(these) <= RANGE:
            parts.append(these[np.argsort(lengths[these], kind="stable")])
            continue
        x = seen[these] - seen[these].mean(axis=0)
        v = x[int((x * x).sum(axis=1).argmax())]
        for _ in range(12):
            v = x.T @ (x @ v)
            v = v / max(float(np.sqrt(v @ v)), 1e-12)
        side = x @ v > 0
        if not 0 < side.sum() < len(these):
            side = np.arange(len(these)) < len(these) // 2
        left += [these[side], these[~side]]
    return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def _shard(held: list):
    """A shard of the documents in ``held``: postings sorted by term and document, and every term's number of documents."""
    import pyarrow as pa

    words, length = [], []
    for part in held:
        w = Words(part.column("text"))
        words.append(w.hash)
        length.append(w.counts())
    length = np.concatenate(length)
    base = len(length)
    doc = np.repeat(np.arange(base), length)
    term, number = np.unique(np.concatenate(words), return_inverse=True)
    order, ends = _alike(doc, number, len(term), length)
    place = np.empty(base, np.int64)
    place[order] = np.arange(base)
    key, tf = np.unique(number * base + place[doc], return_counts=True)
    number, doc = key // base, key % base
    df = np.bincount(number, minlength=len(term))
    starts = np.cumsum(df) - df
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    blob = io.BytesIO()
    np.savez(
        blob,
        ids=np.concatenate([part.column("doc_id").to_numpy() for part in held])[order],
        lengths=length[order].astype(np.int64),
        ends=ends,
        gap=gap.astype(np.uint32 if base > 65535 else np.uint16),
        tf=tf.astype(np.uint16 if not len(tf) or tf.max() < 65536 else np.uint32),
        term=term,
        df=df.astype(np.int32),
    )
    return {
        "shard": pa.array([blob.getvalue()], pa.binary()),
        "docs": pa.array([base], pa.int64()),
        "words": pa.array([int(length.sum())], pa.int64()),
        "terms": pa.array([term.view(np.int64)], pa.list_(pa.int64())),
        "dfs": pa.array([df], pa.list_(pa.int64())),
    }


def _build(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    task = TaskContext.get()
    held: list = []
    size = rows = 0
    number = task.partitionId() if task else 0

    def shard():
        return pa.RecordBatch.from_pydict({"seed": pa.array([number % SEED == 0])} | _shard(held))

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            held.append(part)
            rows += part.num_rows
            size += part.nbytes
            if rows >= SHARD_DOCS or size >= SHARD_BYTES:
                yield shard()
                held, size, rows, number = [], 0, 0, number + 1
    if rows:
        yield shard()


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard; written to the shared folder, since every block of queries reads it."""
    rows = docs.select(id_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "seed boolean, shard binary, docs long, words long, terms array<long>, dfs array<long>"
    return materialize(rows.mapInArrow(_build, schema), "index")


def _query_terms(batches):
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            d, t, _, _ = term_counts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("query_id").take(pa.array(d)), pa.array(t.view(np.int64))], ["query_id", "term"]
            )


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start[i] .. start[i] + count[i] - 1 of all i in a row, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) + np.repeat(start - np.cumsum(count) + count, count), owner


class Shard:
    """A shard in memory: its lists, in blocks by range, with the blocks' greatest impacts."""

    def __init__(self, blob: bytes, mean_length: float):
        z = np.load(io.BytesIO(blob))
        self.ids, self.term, df, tf = z["ids"], z["term"], z["df"].astype(np.int64), z["tf"]
        lengths, n = z["lengths"].astype(np.float64), len(z["ids"])
        ends = np.concatenate(([0], np.cumsum(df)))
        gap = z["gap"]
        run = np.cumsum(gap, dtype=np.int64)
        doc = run - np.repeat(run[ends[:-1]] - gap[ends[:-1]], df) if len(df) else run
        doc = doc.astype(np.uint16 if n <= 65536 else np.uint32)
        norm = K1 * (1 - B + B * lengths / mean_length) if mean_length else np.full(n, K1)
        impact = tf * (K1 + 1) / (tf + norm[doc])
        del run, gap
        number = np.repeat(np.arange(len(df), dtype=np.int32), df)
        #: Range r has the documents first[r] .. first[r + 1].
        self.first = np.concatenate(([0], z["ends"])).astype(np.int64)
        self.ranges = len(self.first) - 1
        at = np.repeat(np.arange(self.ranges), np.diff(self.first)).astype(np.uint8 if self.ranges < 256 else np.uint16)[doc]
        # Every block's greatest impact, by term and range; 0 where a list has no posting.
        self.most = np.zeros((len(df), self.ranges), np.float32)
        cut = np.ones(len(doc), bool)
        cut[1:] = (at[1:] != at[:-1]) | (number[1:] != number[:-1])
        starts = np.flatnonzero(cut)
        if len(starts):
            self.most[number[starts], at[starts]] = np.maximum.reduceat(impact, starts)
        # Postings by document, for exact scores.
        by = np.argsort(doc, kind="stable")
        self.doc_number, self.doc_impact = number[by], impact[by]
        self.doc_at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        # Postings by range and term, for pivots.
        by = np.argsort(at, kind="stable")
        self.doc, self.number, self.impact = doc[by].astype(np.int64), number[by], impact[by].astype(np.float32)
        self.range_at = np.searchsorted(at[by], np.arange(self.ranges + 1))
        self.made: dict[int, tuple] = {}
        #: Queries (as in Best), documents and float32 sums that wait for exact scores.
        self.waiting: list[tuple] = []
        #: Documents that were scored, in float32 (in pivots) and exactly, of all queries (for tests and figures).
        self.touched = self.scored = 0

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of the terms in this shard, -1 for those that it doesn't have."""
        if not len(self.term):
            return np.full(len(terms), -1, np.int32)
        at = np.searchsorted(self.term, terms)
        at[at == len(self.term)] = 0
        return np.where(self.term[at] == terms, at, -1).astype(np.int32)

    def search(self, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best, first: int) -> None:
        """Move a batch of queries through the shard and put what they find into ``best``.

        ``owner`` numbers the batch's queries from 0 and ascends; they are ``first`` .. in ``best``.
        """
        at, n = self.find(terms), int(owner.max(initial=-1)) + 1
        self.move(owner, at, weights, best, first)
        self.settle(at, weights, first, np.searchsorted(owner, np.arange(n + 1)), best)

    def move(self, owner: np.ndarray, at: np.ndarray, weights: np.ndarray, best: Best, first: int) -> None:
        """As :meth:`search`, with the numbers of the terms in this shard; what is found waits for :meth:`settle`."""
        here = at >= 0
        if not here.any():
            return
        owner, at = owner[here], at[here]
        n = int(owner[-1]) + 1
        self.at, self.weight = at, weights[here].astype(np.float32)
        self.query_at = np.searchsorted(owner, np.arange(n + 1))
        slack = self.slack = 1 + ROUNDING * (np.diff(self.query_at) + STEPS)
        # The sum of block maxima of every query in every range.
        bound = np.zeros((n, self.ranges))
        some = np.flatnonzero(np.diff(self.query_at))
        bound[some] = np.add.reduceat(self.most[at] * self.weight[:, None], self.query_at[some], axis=0)
        bound *= slack[:, None]
        bound[bound == 0] = -np.inf
        bound += MARGIN
        floor = best.floor[first : first + n].copy()
        # Queries without a threshold take one from their best sums.
        free = np.full(n, -1)
        none = np.flatnonzero(floor == -np.inf)
        free[none] = np.arange(len(none))
        top = np.zeros((len(none), best.k), np.float32)
        start = np.full(n, -1)
        start[none] = bound[none].argmax(axis=1)
        found: list[tuple] = []
        for r in np.unique(start[none]):
            self._pivot(int(r), np.flatnonzero((start == r) & (bound[:, r] > 0)), floor, free, top, found)
        for r in range(self.ranges):
            self._pivot(r, np.flatnonzero((bound[:, r] >= floor) & (bound[:, r] > 0) & (start != r)), floor, free, top, found)
        if found:
            q, d, score = (np.concatenate(x) for x in zip(*found, strict=True))
            kept = score >= _least(floor, slack)[q]
            self.waiting.append((first + q[kept], d[kept]))

    def _range(self, r: int) -> tuple:
        """A range's matrix of frequent terms, each term's column (-1: none), and all terms' lists."""
        if r not in self.made:
            lo, n = self.first[r], self.first[r + 1] - self.first[r]
            own = slice(self.range_at[r], self.range_at[r + 1])
            doc, number, impact = self.doc[own] - lo, self.number[own], self.impact[own]
            df = np.bincount(number, minlength=len(self.term)).astype(np.int32)
            heavy = np.flatnonzero(df > max(FREQUENT * n, 16))
            column = np.full(len(df), -1, np.int32)
            column[heavy] = np.arange(len(heavy))
            c = column[number]
            dense = np.zeros((len(heavy), n), np.float32)
            held = c >= 0
            dense[c[held], doc[held]] = impact[held]
            self.made[r] = dense, column, doc, impact, df, np.cumsum(df) - df
        return self.made[r]

    def _pivot(self, r: int, queries: np.ndarray, floor: np.ndarray, free: np.ndarray, top: np.ndarray, found: list) -> None:
        """Float32 sums of a range's documents for some queries of the batch; those that may be among the best are found."""
        if not len(queries):
            return
        dense, column, doc, impact, df, begin = self._range(r)
        n, k = dense.shape[1], top.shape[1]
        for a in range(0, len(queries), AT_ONCE):
            some = queries[a : a + AT_ONCE]
            m = len(some)
            entry, line = _spread(self.query_at[some], self.query_at[some + 1] - self.query_at[some])
            at = self.at[entry]
            count = df[at]
            held = np.flatnonzero(count)
            at, count, line, weight = at[held], count[held], line[held], self.weight[entry[held]]
            # Queries with many postings in frequent lists use the matrix, others the lists alone.
            c = column[at]
            postings = np.bincount(line, np.where(c >= 0, count, 0), m)
            row = np.full(m, -1)
            rows = np.flatnonzero(postings * MATRIX > dense.size)
            row[rows] = np.arange(len(rows))
            by_row = row[line]
            heavy = (c >= 0) & (by_row >= 0)
            rare = np.flatnonzero(~heavy)
            heavy = np.flatnonzero(heavy)
            count = count[rare]
            own = np.repeat(np.arange(len(rare)), count)
            place = (begin[at[rare]] - np.cumsum(count) + count).take(own, mode="clip")
            place += np.arange(len(place))
            key = (line[rare] * n).take(own, mode="clip")
            key += doc.take(place, mode="clip")
            part = weight[rare].astype(np.float64).take(own, mode="clip")
            part *= impact.take(place, mode="clip")
            score = np.bincount(key, part, m * n).astype(np.float64, copy=False).reshape(m, n)
            if len(rows):
                matrix = np.zeros((len(rows), len(dense)), np.float32)
                matrix[by_row[heavy], c[heavy]] = weight[heavy]
                if len(rows) == m:
                    score += matrix @ dense
                else:
                    score[rows] += matrix @ dense
            self.touched += score.size
            mine = free[some]
            none = np.flatnonzero(mine >= 0)
            if len(none):
                best = score[none] if n <= k else np.partition(score[none], n - k, axis=1)[:, n - k :]
                best = np.concatenate((top[mine[none]], best), axis=1)
                best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
                top[mine[none]] = best
                least = best.min(axis=1)
                floor[some[none]] = np.where(least > 0, least / self.slack[some[none]] ** 2 - MARGIN, -np.inf)
            q, d = np.nonzero(score >= _least(floor[some], self.slack[some])[:, None])
            found.append((some[q], self.first[r] + d, score[q, d]))

    def settle(self, at: np.ndarray, weights: np.ndarray, first: int, ends: np.ndarray, best: Best) -> None:
        """Put the exact scores of what was found into ``best``.

        Terms ``ends[i]`` .. ``ends[i + 1]`` are those of query ``first`` + i of ``best``.
        """
        if not self.waiting:
            return
        query, doc = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting = []
        by = np.argsort(doc, kind="stable")
        query, doc = query[by], doc[by]
        these, number = np.unique(doc, return_inverse=True)
        table = np.zeros((EXACT_AT_ONCE, len(self.term) + 1))
        score = np.empty(len(doc))
        size = ends[query - first + 1] - ends[query - first]
        for a in range(0, len(these), EXACT_AT_ONCE):
            some = these[a : a + EXACT_AT_ONCE]
            place, line = _spread(self.doc_at[some], self.doc_at[some + 1] - self.doc_at[some])
            term = self.doc_number[place]
            table[line, term] = self.doc_impact[place]
            lo, hi = np.searchsorted(number, (a, a + EXACT_AT_ONCE))
            while lo < hi:  # Some terms at a time.
                b = lo + max(int(np.searchsorted(np.cumsum(size[lo:hi]), 1_000_000)), 1)
                b = min(b, hi)
                entry, pair = _spread(ends[query[lo:b] - first], size[lo:b])
                # Terms that the shard doesn't have (-1) meet the table's last column, which stays 0.
                part = table[(number[lo:b] - a)[pair], at[entry]] * weights[entry]
                score[lo:b] = np.bincount(pair, part, b - lo)
                lo = b
            table[line, term] = 0
        self.scored += len(doc)
        score = np.round(score, DIGITS)
        kept = np.flatnonzero((score >= best.floor[query]) & (score > 0))
        if len(kept):
            best.put(query[kept], self.ids[doc[kept]], score[kept])


def _least(floor: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """What a float32 sum must reach so that the exact score can reach the threshold."""
    return np.maximum((floor - MARGIN) / slack**2, 1e-30)


class Best:
    """The best k documents of every query so far, and the score that further ones must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.doc = np.zeros((n, k), np.int64)
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()

    def put(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        these = np.unique(query)
        q = np.concatenate((query, np.repeat(these, self.k)))
        d = np.concatenate((doc, self.doc[these].ravel()))
        s = np.concatenate((score, self.score[these].ravel()))
        by = np.lexsort((d, -s, q))
        q, d, s = q[by], d[by], s[by]
        first = np.searchsorted(q, these)
        at = (first[:, None] + np.arange(self.k)).ravel()
        self.doc[these], self.score[these] = d[at].reshape(-1, self.k), s[at].reshape(-1, self.k)
        self.floor[these] = np.maximum(self.floor[these], self.score[these, -1])


def _batches(ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of queries that move together."""
    out, a = [], 0
    while a < len(ends) - 1:
        b = min(a + BATCH, len(ends) - 1)
        b = max(a + 1, min(b, int(np.searchsorted(ends, ends[a] + BATCH_WORDS, side="right")) - 1))
        out.append((a, b))
        a = b
    return out


def _search(queries, mean_length: float, k: int):
    def run(batches):
        import pyarrow as pa

        query_ids, ends, known, number, weights, floor = queries.value
        best = Best(len(query_ids), k, floor)
        for batch in batches:
            for blob in batch.column("shard"):
                shard = Shard(blob.as_py(), mean_length)
                found = shard.find(known)
                for a, b in _batches(ends):
                    own = slice(ends[a], ends[b])
                    owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                    shard.move(owner, found[number[own]], weights[own], best, a)
                shard.settle(found[number], weights, 0, ends, best)
        for a in range(0, len(query_ids), 1024):
            q, d = np.nonzero(best.score[a : a + 1024] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[a + q]), pa.array(best.doc[a + q, d]), pa.array(best.score[a + q, d])],
                ["query_id", "doc_id", "score"],
            )

    return run


@contextmanager
def _one_a_batch(spark: SparkSession):
    """Rows go to Python one by one: a row is a shard, and several would be held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, 1)
    try:
        yield
    finally:
        spark.conf.set(key, held)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), doc_id and score: the k best documents of every query.

    ``queries`` has query_id and text. Null texts have no words, so they match nothing;
    a null doc_id stays null and comes first among ties; queries with a null id are left out.
    Rows of ``queries`` with one id are one query of all their words. Documents are rows:
    repeated rows are found each, in the order of their ids. Documents that share no word with
    a query are left out, so a query can have fewer than k rows, or none. Other columns are
    left out, texts can have any length, and empty tables give no rows.

    Queries are searched in blocks of at most QUERY_WORDS words (and one query more), each
    sent to all shards; a block's broadcast is freed after it.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    total = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    n, words = total["n"] or 0, total["words"] or 0
    asked = queries.where("query_id is not null").select(
        F.col("query_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    terms = materialize(asked.mapInArrow(_query_terms, "query_id long, term long").distinct(), "query-words")
    df = (
        index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
        .select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    weighted = terms.join(df, "term").select(
        "query_id", "term", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    blocked, blocks = _blocks(materialize(weighted, "query-terms"))
    found = [spark.createDataFrame([], "query_id long, doc_id long, score double")]
    for block in range(blocks):
        own = blocked.where(F.col("block") == block).orderBy("query_id", "term").toArrow()
        q = own["query_id"].to_numpy()
        if not len(q):
            continue
        at = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        known, number = np.unique(own["term"].to_numpy().view(np.uint64), return_inverse=True)
        sent = (q[at], np.append(at, len(q)), known, number.astype(np.int32), own["idf"].to_numpy())
        floor = np.full(len(at), -np.inf)
        for seeds in (True, False):
            value = spark.sparkContext.broadcast((*sent, floor))
            with _one_a_batch(spark):
                rows = index.where(F.col("seed") if seeds else ~F.col("seed")).select("shard")
                rows = rows.mapInArrow(_search(value, words / n, k), "query_id long, doc_id long, score double")
                part = materialize(rows, "found")
            value.destroy()
            found.append(part)
            if seeds:
                # A query's k-th best score among the seeds; all others must reach it. One number a query of the block.
                kth = part.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc())))
                held = kth.where(F.col("at") == k).select("query_id", "score").toArrow()
                floor[np.searchsorted(sent[0], held["query_id"].to_numpy())] = held["score"].to_numpy()
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return (
        every.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
    )


def _blocks(terms: DataFrame) -> tuple[DataFrame, int]:
    """The terms with the number of their query's block, and the number of blocks."""
    n = max(-(-terms.count() // QUERY_WORDS), 1)
    block: Column = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return terms.withColumn("block", block), n
