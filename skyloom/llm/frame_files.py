"""Token-id files: one independent zstandard frame a document, and a trailing seek table.

A file is::

    frame 0 | frame 1 | ... | seek table | end mark

* A frame holds the ids of one document as little-endian unsigned integers of 2 or 4
  bytes and can be decompressed without any other frame.
* The seek table is a zstandard skippable frame (magic 0x184D2A5E). It has an entry for
  every frame (doc_id int64, is-null uint8, frame bytes uint32, ids uint32, CRC-32 of
  the frame's uncompressed bytes uint32) and a footer (part uint32, file in the part
  uint32, frames uint32, id width uint8, magic ``ZTOKSEEK``).
* The end mark is an empty skippable frame, so ``zstd -d`` reads a whole file as well.

Spark's own text writer puts the files in place, so its commit protocol covers lost
executors and repeated tasks, on any store that Spark can write to. This relies on two
things: a cast of binary to string keeps all bytes as they are, valid UTF-8 or not, and the
writer copies a string's bytes and puts its line separator, here the end mark, after them.
The checksums would tell if a Spark version did otherwise.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.common import materialize, scratch
from skyloom.llm.tokens import encoder

#: An empty skippable frame: magic 0x184D2A50 and size 0. All bytes are ASCII, so it can be the writer's line separator.
END_MARK = "P*M\x18\x00\x00\x00\x00"
SKIPPABLE = 0x184D2A5E
ENTRY = struct.Struct("<qBIII")
FOOTER = struct.Struct("<IIIB8s")
MAGIC = b"ZTOKSEEK"
#: A file is closed when its frames reach this size, so a file in memory is bounded by this and one document.
FILE_BYTES = 8_000_000


class FrameWriter:
    """Collects frames and gives the bytes of a file, without the end mark."""

    def __init__(self, part: int, number: int, width: int, level: int = 1):
        import zstandard

        self.part, self.number, self.width = part, number, width
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.entries: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.frames.append(frame)
        self.entries.append(
            ENTRY.pack(doc_id or 0, doc_id is None, len(frame), len(ids) // self.width, zlib.crc32(ids))
        )
        self.size += len(frame)

    def close(self) -> bytes:
        footer = FOOTER.pack(self.part, self.number, len(self.frames), self.width, MAGIC)
        table = b"".join(self.entries) + footer
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class FrameReader:
    """Reads single documents of a file through its seek table.

    ``source`` is a seekable binary file; only the table and the frames asked for are read.
    """

    def __init__(self, source):
        import zstandard

        self.source = source
        self.decompress = zstandard.ZstdDecompressor().decompress
        end = source.seek(0, io.SEEK_END) - len(END_MARK)
        source.seek(end - FOOTER.size)
        self.part, self.number, n, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file: there is no seek table at its end")
        source.seek(end - FOOTER.size - n * ENTRY.size)
        self.entries = list(ENTRY.iter_unpack(source.read(n * ENTRY.size)))
        self.starts, at = [], 0
        for e in self.entries:
            self.starts.append(at)
            at += e[2]

    def doc_id(self, i: int) -> int | None:
        return None if self.entries[i][1] else self.entries[i][0]

    def frame(self, i: int) -> bytes:
        """The packed ids of the file's i-th document, checked against its checksum."""
        _, _, size, n, crc = self.entries[i]
        self.source.seek(self.starts[i])
        ids = self.decompress(self.source.read(size), max_output_size=n * self.width)
        if zlib.crc32(ids) != crc or len(ids) != n * self.width:
            raise ValueError(f"frame {i}: the checksum doesn't match")
        return ids

    def find(self, doc_ids: Iterable[int | None]) -> Iterator[tuple[int | None, bytes]]:
        wanted = set(doc_ids)
        for i in range(len(self.entries)):
            if self.doc_id(i) in wanted:
                yield self.doc_id(i), self.frame(i)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text and write the files under ``path``, in ascending doc_id.

    Null texts count as empty: they have the end id alone. A null doc_id comes first and
    stays null. Rows that share an id stay apart, in the order of their texts. Other
    columns are left out. Documents are dealt to tasks by ranges of doc_id.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = end_id.to_bytes(enc.width, "little")
        part, number = TaskContext.get().partitionId(), 0
        out = FrameWriter(part, number, enc.width)

        def blob():
            return pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], ["file"])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for doc_id, text in zip(ids, texts, strict=True):
                out.add(doc_id, enc.encode(text.as_py()) + end)
                if out.size >= FILE_BYTES:
                    yield blob()
                    number += 1
                    out = FrameWriter(part, number, enc.width)
        if out.frames:
            yield blob()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    files = ordered.mapInArrow(write, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", END_MARK).option(
        "maxRecordsPerFile", 1
    ).text(path)


def read_tokens(spark, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, part, file, place (in the file), ids (packed), width of the documents.

    With ``doc_ids``, only frames of those documents are decompressed.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                r = FrameReader(io.BytesIO(content.as_py()))
                wanted = None if doc_ids is None else set(doc_ids)
                rows = [i for i in range(len(r.entries)) if wanted is None or r.doc_id(i) in wanted]
                for k in range(0, len(rows), 1024):
                    own = rows[k : k + 1024]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([r.doc_id(i) for i in own], pa.int64()),
                            "part": pa.array([r.part] * len(own), pa.int32()),
                            "file": pa.array([r.number] * len(own), pa.int32()),
                            "place": pa.array(own, pa.int32()),
                            "ids": pa.array([r.frame(i) for i in own], pa.binary()),
                            "width": pa.array([r.width] * len(own), pa.int32()),
                        }
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(read, "doc_id long, part int, file int, place int, ids binary, width int")


def token_report(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files, read them back, and give doc_id, start, n_tokens and ids_crc32 of every document.

    ``start`` counts the ids of all documents before it. Nulls, ties and empty tables as
    in :func:`write_tokens`.
    """
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            crcs, ns = [], []
            for ids, width in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True):
                wide = np.frombuffer(ids.as_py(), dtype=f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(wide.tobytes()))
                ns.append(len(wide))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "part", "file", "place")]
                + [pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "part", "file", "place", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id long, part int, file int, place int, n_tokens long, ids_crc32 long"
    light = materialize(read_tokens(spark, path).mapInArrow(digest, schema), "token-report")
    # Starts in three steps, each over few rows: parts, files of a part, documents of a file.
    files = light.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    upto = (Window.unboundedPreceding, -1)
    of_part = parts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("p0")
    )
    of_file = files.select(
        "part",
        "file",
        F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file").rowsBetween(*upto)), F.lit(0)).alias("f0"),
    )
    inside = Window.partitionBy("part", "file").orderBy("place").rowsBetween(*upto)
    placed = light.withColumn("d0", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return (
        placed.join(of_file, ["part", "file"])
        .join(of_part, "part")
        .select("doc_id", (F.col("p0") + F.col("f0") + F.col("d0")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )
