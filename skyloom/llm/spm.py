"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file, a protobuf, is read field by field: pieces with scores and types, and the
trainer's and normaliser's settings. From these a tokenizer is built: unigram scores, or
byte-pair merges in the order of scores; byte fallback; the meta-space mark; the
normaliser. Batches are encoded and decoded by the library's threads, and each whole text is
compared with what the sentencepiece library makes of it.

Words recur, and where no piece crosses the front of a word, a text's ids are those of its
words in a row. There each worker keeps the ids of words it has met and the library's model encodes new ones only;
parity and round trips are still judged on whole texts, so a difference in context shows.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads that encode a batch, and bytes of text in one; a longer text is a batch of its own.
THREADS, BATCH_BYTES = 2, 500_000
#: Words a worker keeps the ids of, of those met last and of those before, and their greatest length.
KEPT_WORDS, KEPT_CHARS = 300_000, 64


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at += 1
            if b < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} isn't used by model files")
        yield number, kind, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    unk_id: int = 0
    normalizer: str = "identity"
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, _, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                for n, _, v in fields(value):
                    if n == 3:
                        m.unigram = v == 1
                        if v not in (1, 2):
                            raise ValueError("only unigram and byte-pair models are supported")
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 40:
                        m.unk_id = v
            elif number == 3:
                for n, _, v in fields(value):
                    if n == 1:
                        m.normalizer = v.decode()
                    elif n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.drop_extra_spaces = bool(v)
                    elif n == 5:
                        m.escape_spaces = bool(v)
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first; ties by the pieces' order, as when merging."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for p, score, kind in self.pieces:
            if kind != NORMAL or len(p) < 2:
                continue
            for i in range(1, len(p)):
                if p[:i] in rank and p[i:] in rank:
                    out.append((-score, rank[p], rank[p[:i]], rank[p[i:]], p[:i], p[i:]))
        return [(a, b) for *_, a, b in sorted(out)]

    def tokenizer(self):
        """A tokenizer of the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.unigram:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk_id, self.byte_fallback)
        else:
            model = models.BPE(
                {p: i for i, (p, _, _) in enumerate(self.pieces)},
                self.merges(),
                unk_token=self.pieces[self.unk_id][0],
                fuse_unk=True,
                byte_fallback=self.byte_fallback,
            )
        t = Tokenizer(model)
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.drop_extra_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", SPACE))
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        if self.words_apart():
            # A piece has the mark in front only, so no merge crosses the front of a run of marks.
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
        t.decoder = self.decoder()
        return t

    def decoder(self):
        from tokenizers import decoders

        return decoders.Sequence(
            [decoders.Replace(SPACE, " "), *([decoders.ByteFallback()] if self.byte_fallback else []), decoders.Fuse()]
            + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])
        )

    def words_apart(self) -> bool:
        return all(SPACE not in p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER))


class _Words(dict):
    """A word -> its ids by the library's model; ``front`` is put before it, a space stands for the mark.

    When full, its words become the older ones, which come back as they are met: rare words don't keep frequent ones out.
    """

    def __init__(self, model, front: str):
        tokenize = model.tokenize
        older: dict[str, tuple[int, ...]] = {}

        def missing(word: str) -> tuple[int, ...]:
            nonlocal older
            ids = older.get(word)
            if ids is None:
                ids = tuple([t.id for t in tokenize(front + word.replace(" ", SPACE))])
            if len(word) <= KEPT_CHARS:
                if len(self) >= KEPT_WORDS:
                    older = dict(self)
                    self.clear()
                self[word] = ids
            return ids

        self.missing = missing

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.missing(word)


class Codec:
    """Encodes batches, decodes ids, and compares both with the sentencepiece library."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import decoders

        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.tokenizer = self.model.tokenizer()
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        m = self.model
        self.cut = (
            re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
            if m.words_apart() and m.escape_spaces and not m.drop_extra_spaces and not m.charsmap and m.normalizer == "identity"
            else None
        )
        #: Words as they are, and words that follow a space of their text, or its lead, without it.
        self.known, self.spaced = _Words(self.tokenizer.model, ""), _Words(self.tokenizer.model, SPACE)
        # Pieces are joined by the library, marks become spaces in the whole text: one pass in place of one a piece.
        self.tokenizer.decoder = decoders.ByteFallback() if m.byte_fallback else decoders.Fuse()
        #: Bytes of the mark. Where they stand as bytes they stay a mark, so the decoder that goes by piece is asked.
        self.mark_bytes = [self.tokenizer.token_to_id(f"<0x{b:02X}>") for b in SPACE.encode()] if m.byte_fallback else []
        self.by_piece = m.decoder()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, by the library's own threads. An empty text has no ids, as in sentencepiece."""
        full = [t for t in texts if t]
        found = iter(self.tokenizer.encode_batch_fast(full, add_special_tokens=False))
        return [next(found).ids if t else [] for t in texts]

    def encode_words(self, texts: list[str]) -> list[list[int]]:
        """As :meth:`encode_batch`, word by word: known words aren't encoded again."""
        if self.cut is None:
            return self.encode_batch(texts)
        return [list(chain.from_iterable(self._words(t))) if t else [] for t in texts]

    def _words(self, text: str) -> Iterator[tuple[int, ...]]:
        if self.model.dummy_prefix and text[0] != " " and "  " not in text and SPACE not in text:
            return map(self.spaced.__getitem__, text.split(" "))
        return map(self.known.__getitem__, self.cut.findall(" " + text if self.model.dummy_prefix else text))

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        out = []
        for own, text in zip(ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True):
            if self.mark_bytes and all(b in own for b in self.mark_bytes):
                pieces = [self.tokenizer.id_to_token(i) for i in own]
                out.append(self.by_piece.decode([p for p in pieces if p is not None]))
                continue
            text = text.replace(SPACE, " ")
            out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch([ids])[0]

    def check(self, texts: list[str]) -> list[tuple[bytes, bool, str]]:
        """Ids of every whole text, parity, and the text decoded from the ids.

        Parity: sentencepiece gives the same ids for the text and the same text for the ids.
        """
        ours, theirs = self.encode_words(texts), self.reference.encode(texts, num_threads=self.threads)
        back, wanted = self.decode_batch(ours), self.reference.decode(ours) if ours else []
        return [(pack(a), a == b and t == u, t) for a, b, t, u in zip(ours, theirs, back, wanted, strict=True)]


def pack(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(batch):
    """Slices of a batch with BATCH_BYTES of text at most, or one text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + BATCH_BYTES, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            for part in _slices(batch):
                found = c.check([t if t is not None else "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found])],
                    [*part.schema.names, "ids", "parity"],
                )

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [list(struct.unpack(f"<{len(x or b'') // 4}I", x or b"")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(c.decode_batch(ids))], [*part.schema.names, "decoded"]
                )

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ids (packed uint32) and parity (whether sentencepiece agrees). Columns of these names are replaced."""
    from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

    own = docs.drop("ids", "parity")
    schema = StructType([*own.schema.fields, StructField("ids", BinaryType()), StructField("parity", BooleanType())])
    return own.mapInArrow(_encode(model), schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the text of its ids as column decoded."""
    from pyspark.sql.types import StringType, StructField, StructType

    own = encoded.drop("decoded")
    return own.mapInArrow(_decode(model), StructType([*own.schema.fields, StructField("decoded", StringType())]))


def report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, decoded_sha256 and round_trip of every document.

    Null texts count as empty and have no ids. A null doc_id stays null, repeated rows are
    encoded each, other columns are left out, and an empty table gives no rows. Texts of any
    length are encoded and decoded whole. ``parity`` tells whether sentencepiece gives the same
    ids for the whole text and the same text for the ids, ``round_trip`` whether the text that
    is decoded from the ids is the input.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        c = codec(model)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column("text").to_pylist()
                found = c.check(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x, _, _ in found], pa.int64()),
                        pa.array([zlib.crc32(x) for x, _, _ in found], pa.int64()),
                        pa.array([same for _, same, _ in found]),
                        pa.array([hashlib.sha256(back.encode()).hexdigest() for _, _, back in found]),
                        pa.array([back == t for (_, _, back), t in zip(found, texts, strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "parity", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, decoded_sha256 string, round_trip boolean"
    )
