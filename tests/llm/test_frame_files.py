import glob
import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from skyloom.llm import frame_files, tokens
from skyloom.llm.queries import BYTE_BPE, WORD_BPE

TEXTS = [
    "", " ", "a\nb", "Foo  bar", "x\ty", "\n\n a", "a \n", "é́ b", "it's don't 've", "<|endoftext|> a", "\x1ca b",
    "a b 　c", "a.\n", "\na", "ÀÉ... ßtra; a", "a ... b", "a|b |c ﬁ ①", "Ünder\nÉ", " a", "a ́b", "ſ K İ", "á. b",
    "日本語 テキスト。", "1234 5,6", "word " * 3000,
    "one <|endoftext|> two", "<|startoftext|>a<|ENDOFTEXT|> b", "x<|endoftext|>  y\n", "a < b <| c |> <|endoftex|>",
]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_ids_are_those_of_whole_texts(path):
    enc, ref = tokens.TextEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # words are kept the second time
        for t in TEXTS:
            got = np.frombuffer(enc.encode(t), enc.dtype).tolist()
            assert got == ref.encode(t, add_special_tokens=False).ids, t


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 2)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 2)
    small, large = tokens.TextEncoder(BYTE_BPE), tokens.TextEncoder(WORD_BPE)
    for enc in (small, large):
        assert [enc.encode(t) for t in TEXTS] == [tokens.TextEncoder(enc is small and BYTE_BPE or WORD_BPE).encode(t) for t in TEXTS]
        assert len(enc.words) <= 2 and len(enc.pieces) <= 2


def expected(rows):
    ref = Tokenizer.from_file(BYTE_BPE)
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*ref.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_report_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(frame_files, "FILE_BYTES", 50)  # several files a part
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)]) for i in range(50)] + [(None, "x y"), (None, None), (3, "twice"), (3, "twice"), (51, "long " * 200_000)]
    got = [tuple(r) for r in frame_files.token_report(docs(rows, 4).selectExpr("*", "1 part", "2 file", "3 place", "4 start"), BYTE_BPE, 2).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)
    assert frame_files.token_report(docs([]), BYTE_BPE, 2).count() == 0


def test_reader_decompresses_only_what_is_asked_for(spark, docs, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(i, f"text number {i} " * (i + 1)) for i in range(40)]
    frame_files.write_tokens(docs(rows, 2), path, BYTE_BPE, 2)
    names = glob.glob(f"{tmp_path}/out/*.txt")
    seen = []
    for name in names:
        with open(name, "rb") as f:
            r = frame_files.FrameReader(f)
            calls = []
            real = r.decompress
            r.decompress = lambda x, real=real, calls=calls, **k: calls.append(1) or real(x, **k)
            found = dict(r.find([5, 33]))
            assert len(calls) == len(found)
            seen += found
        whole = open(name, "rb").read()
        assert whole.endswith(frame_files.END_MARK.encode())
        broken = bytearray(whole)
        broken[3] ^= 255
        with pytest.raises(Exception):
            frame_files.FrameReader(io.BytesIO(bytes(broken))).frame(0)
    assert sorted(seen) == [5, 33]
    got = frame_files.read_tokens(spark, path, [5, 33]).collect()
    assert sorted(r.doc_id for r in got) == [5, 33]
    with pytest.raises(ValueError):
        frame_files.FrameReader(io.BytesIO(b"x" * 100))


def test_words_after_a_newline_are_known():
    enc, plain = tokens.TextEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = ["a word.\nThe line\nthé end,\n", "\nstart 12\n34 it's\n's x\n.y", "ªb\nµm º. Aµ ..a\n", "\n", "a\n\nb c", "x \ny", "日本\n日 é%%\n%% q"]
    for _ in range(2):
        for t in texts:
            assert enc.encode(t) == enc._np.array(plain.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes(), t
    assert "\nThe" in enc.words and "word.\nThe" not in enc.words
