"""Document fingerprints as Merkle trees over pieces, paragraphs and sections.

A text is cut into sections at empty lines, sections into paragraphs at line ends, and
paragraphs into pieces of a few words. Pieces end where the content says so, after a word
that ends in one of ``ENDS``, so an inserted word changes the pieces around it and no others.
A piece's hash is that of its text, a paragraph's that of its pieces' hashes, a section's that
of its paragraphs' hashes, the root's that of all sections'. Pieces keep all white space, so
equal roots mean equal texts; where roots differ, the sections, paragraphs and pieces that
differ locate the edit.

The fingerprint is text::

    root|section:paragraph.piece,piece;paragraph.piece|section:...

with 32 hex digits for the root, 10 for sections, 8 for paragraphs and pieces; a paragraph
without pieces has no point. All of it is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.common import id_key, materialize

#: A piece ends after such a character if white space follows, or after such a mark: about every third to sixth word.
ENDS, MARKS = ".!?cfilorux0369", "。、，！？"
#: Rows in a bucket of neighbours; ranges that buckets are dealt to; a cell with more than so many times the rows is
#: cut again, so many times at most.
BUCKET_ROWS, RANGES, HEAVY, CUTS = 256, 64, 4, 5


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cut_pieces(p: Column) -> Column:
    parts = F.split(p, rf"(?<=[{ENDS}])(?=[ \t])|(?<=[{MARKS}])")
    return F.filter(parts, lambda x: x != "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""

    def paragraph(p: Column) -> Column:
        def node(marks: Column) -> Column:
            h = F.md5(F.array_join(marks, ""))
            own = F.array_join(F.transform(marks, lambda m: F.substring(m, 1, 8)), ",")
            return F.struct(h.alias("h"), F.when(own == "", "").otherwise(F.concat(F.lit("."), own)).alias("p"))

        return let(F.transform(cut_pieces(p), lambda x: F.md5(x)), node)

    def section(s: Column) -> Column:
        def node(own: Column) -> Column:
            line = F.array_join(F.transform(own, lambda x: F.concat(F.substring(x["h"], 1, 8), x["p"])), ";")
            return F.struct(F.md5(F.array_join(own["h"], "")).alias("h"), line.alias("p"))

        return let(F.transform(F.split(s, "\n"), paragraph), node)

    def root(sections: Column) -> Column:
        body = F.array_join(F.transform(sections, lambda x: F.concat(F.substring(x["h"], 1, 10), F.lit(":"), x["p"])), "|")
        return F.concat(F.md5(F.array_join(sections["h"], "")), F.lit("|"), body)

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), root)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are: the pieces under equal nodes, as a share of all pieces.

    The trees are walked from the root. Equal sections count with all their pieces and aren't
    looked into; the paragraphs of the others are compared, and the pieces of those that
    differ. Repeats of a node count once. With w for the number of pieces under some nodes,
    this is 2 (w(equal sections) + w(equal paragraphs) + equal pieces) / (w(a) + w(b)):
    1 for equal texts, 0 for texts without a common piece.
    """

    def weight(nodes: Column) -> Column:
        line = F.array_join(nodes, "|")
        return F.length(line) - F.length(F.translate(line, ".,", ""))

    def sections(fp: Column) -> Column:
        return F.array_distinct(F.split(F.substring(fp, 34, 2**31 - 1), r"\|"))

    def paragraphs(rest: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(rest, lambda s: F.split(F.substring(s, 12, 2**31 - 1), ";"))))

    def leaves(rest: Column) -> Column:
        marked = F.filter(rest, lambda p: F.length(p) > 8)
        return F.array_distinct(F.flatten(F.transform(marked, lambda p: F.split(F.substring(p, 10, 2**31 - 1), ","))))

    def walk(x: Column, y: Column, down, last) -> Column:
        """Equal nodes' weight and what ``down`` finds under the others."""
        def below(p: Column) -> Column:
            return let(last(F.array_except(y, x)), lambda q: down(p, q))

        return weight(F.array_intersect(x, y)) + let(last(F.array_except(x, y)), below)

    def compared(x: Column, y: Column) -> Column:
        def in_paragraphs(p: Column, q: Column) -> Column:
            return walk(p, q, lambda u, v: F.size(F.array_intersect(u, v)), leaves)

        return 2.0 * walk(x, y, in_paragraphs, paragraphs) / F.greatest(weight(x) + weight(y), F.lit(1))

    unequal = let(sections(a), lambda x: let(sections(b), lambda y: compared(x, y)))
    return F.when(a == b, 1.0).otherwise(unequal).cast("double")


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of ``a`` whose hash isn't among those of ``b``. Both are stored columns."""
    def sections(fp: Column) -> Column:
        parts = F.split(fp, r"\|")
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda s: F.substring(s, 1, 10))

    mine, theirs = sections(a), sections(b)
    numbered = F.transform(mine, lambda s, i: F.when(~F.array_contains(theirs, s), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _inside(key: Column, lo: Column, hi: Column, parts: Column) -> Column:
    """The part, of ``parts`` equal ones between lo and hi, that a key is in: from 0 on."""
    at = F.floor((key.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double") + 1.0) * parts)
    return F.greatest(F.least(at, parts - 1), F.lit(0)).cast("long")


def neighbour_buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text_hash, ...) with __bucket, which keeps the order of (doc_id, text_hash), and
    (__bucket, __to): the bucket after each one.

    Buckets hold about BUCKET_ROWS neighbours each. Ids are dealt to ranges by quantiles and to
    cells of equal width inside; a cell that holds more than HEAVY times as many rows is cut
    again between its own least and greatest id, up to CUTS times, and a cell of one id by its
    texts' hashes. So far ids, or an id that many rows share, make no large bucket; only rows
    with one id and one text stay together. The last bucket is followed by the first. All is
    found from ids and hashes. Tables of cells to cut again have a row for HEAVY x BUCKET_ROWS rows
    at most, none for ids that are spread evenly, and are joined without a broadcast hint.
    """
    light = docs.select(id_key().alias("__k"), F.col("text_hash").alias("__h"))
    share = [i / RANGES for i in range(RANGES + 1)]
    stats = light.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__k", share, 10_000).alias("q")).first()
    n, q = stats["n"], sorted(set(stats["q"] or [0]))
    per_range = max(1, -(-n // (RANGES * BUCKET_ROWS)))
    low = F.lit(q)

    def first_cells(df: DataFrame) -> DataFrame:
        key = F.col("__k")
        range_no = F.greatest(F.size(F.filter(low, lambda x: x <= key)), F.lit(1))
        ranged = df.withColumn("__range", range_no.cast("long"))
        lo = F.element_at(low, F.col("__range").cast("int"))
        hi = F.element_at(low, F.least(F.col("__range") + 1, F.lit(len(q))).cast("int"))
        return ranged.withColumn("__c0", _inside(key, lo, hi, F.lit(per_range)))

    def cut_again(df: DataFrame, heavy: DataFrame, names: list[str], out: str) -> DataFrame:
        joined = df.join(heavy, names, "left")
        parts = F.ceil(F.col("__n") / BUCKET_ROWS)
        # Hashes span all of 64 bits: halves keep their differences in range.
        by_hash = _inside(F.col("__h") / 2, F.lit(-(2.0**62)), F.lit(2.0**62), parts)
        by_key = _inside(F.col("__k"), F.col("__lo"), F.col("__hi"), parts)
        cell = F.when(F.col("__n").isNull(), F.lit(0)).when(F.col("__lo") == F.col("__hi"), by_hash).otherwise(by_key)
        return joined.withColumn(out, cell.cast("long")).drop("__n", "__lo", "__hi")

    def heavy_cells(df: DataFrame, names: list[str]) -> DataFrame:
        found = df.groupBy(names).agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__lo"), F.max("__k").alias("__hi"))
        return materialize(found.where(F.col("__n") > HEAVY * BUCKET_ROWS), "heavy-cells")

    cells = first_cells(light)
    names, cuts = ["__range", "__c0"], []
    for out in (f"__c{i + 1}" for i in range(CUTS)):
        heavy = heavy_cells(cells, names)
        if heavy.isEmpty():
            break
        cuts.append((heavy, list(names), out))
        cells = cut_again(cells.join(heavy.select(names), names, "left_semi"), heavy, names, out)
        names.append(out)
    light_cells, rows = first_cells(light), first_cells(docs.withColumn("__k", id_key()).withColumn("__h", F.col("text_hash")))
    for heavy, keys, out in cuts:
        light_cells, rows = (cut_again(x, heavy, keys, out) for x in (light_cells, rows))
    bucket = F.struct(*names).alias("__bucket")
    rows = rows.select(*docs.columns, bucket)

    # Inside a range the next bucket comes from a window, between ranges from their first buckets.
    seen = light_cells.select(bucket, "__range").distinct()
    heads = seen.groupBy("__range").agg(F.min("__bucket").alias("b")).orderBy("__range").collect()
    after = {r["__range"]: heads[(i + 1) % len(heads)]["b"] for i, r in enumerate(heads)}
    follow = seen.withColumn("__to", F.lead("__bucket").over(Window.partitionBy("__range").orderBy("__bucket")))
    if after:

        def value(b) -> Column:
            return F.struct(*[F.lit(b[c]).cast("long").alias(c) for c in names])

        jump = F.create_map(*[x for k, b in after.items() for x in (F.lit(k).cast("long"), value(b))])
        follow = follow.withColumn("__to", F.coalesce("__to", F.element_at(jump, F.col("__range"))))
    return rows, follow.select("__bucket", "__to")


def _compared(rows: DataFrame) -> DataFrame:
    """The report's columns from text, next_text and both texts' fingerprints."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    return (
        rows.withColumn("n_chars", n.cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_fingerprint", fingerprint(F.col("edited")))
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    )


REPORT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter of code points replaced by as many from the head
    of the next document by (doc_id, xxhash64 of the text); after the last comes the first.
    Null texts count as empty, a null doc_id stays null and comes first, repeated rows follow
    one another, a single row is its own next, other columns are left out, texts can have any
    length, and an empty table gives no rows.

    Texts are shuffled once, to buckets of neighbours. The last row of a bucket, one in
    BUCKET_ROWS, needs the first row of the next bucket: the texts of these rows are kept
    beside the written results and meet in a join of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucketed, follow = neighbour_buckets(rows.withColumn("text_hash", F.xxhash64("text")))
    dealt = bucketed.repartition("__bucket")
    order = Window.partitionBy("__bucket").orderBy(id_key(), "text_hash")
    ahead = (
        dealt.withColumn("fingerprint", fingerprint(F.col("text")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .withColumn("__first", F.row_number().over(order) == 1)
    )
    last = F.col("next_text").isNull()
    made = _compared(ahead.withColumn("__last", last)).select(
        *REPORT,
        "__bucket",
        "__last",
        "__first",
        F.when(F.col("__first") | F.col("__last"), F.col("text")).alias("text"),
    )
    made = materialize(made, "merkle")
    ends = made.where("__last").select("doc_id", "text", "fingerprint", "__bucket")
    heads = made.where("__first").select(
        F.col("__bucket").alias("__to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    joined = ends.join(follow, "__bucket").join(heads, "__to")
    return made.where("not __last").select(REPORT).union(_compared(joined).select(REPORT))
