import random
import struct

import pytest
import sentencepiece

from skyloom.llm import spm
from skyloom.llm.queries import PIECE_BPE


def texts(n=400):
    r = random.Random(1)
    fixed = ["", " ", "  a  b\n c ", "é́ ﬁ ①", "▁ a▁b", "日本語 text", "\t\tx", "a  ", "<s> </s> <unk>", "\x00", "<0x41>", "   ", "▁", "a▁▁b"]
    return fixed + ["".join(r.choice("ab é日 \n▁<s>0①\t") for _ in range(r.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("kept", [150_000, 3])
def test_parity_with_sentencepiece(kept, monkeypatch):
    monkeypatch.setattr(spm, "KEPT_WORDS", kept)
    c, ref = spm.Codec(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    t = [*texts(), "long " * 40_000]
    assert c.threads > 1 and c.encode_batch(t) == ref.encode(t)
    for _ in range(2):
        for text, (ids, same, back) in zip(t, c.check(t), strict=True):
            ids = list(struct.unpack(f"<{len(ids) // 4}I", ids))
            assert same and ids == ref.encode(text)
            assert back == ref.decode(ids)


def test_every_document_is_encoded_and_decoded_whole(monkeypatch):
    """Known words don't stand in for a text: a wrong id or a wrong text in context shows."""
    c = spm.Codec(PIECE_BPE)
    t = ["some words of a text", "some words of a text again"]
    assert [x[1] for x in c.check(t)] == [True, True]
    plain = c.encode_words
    monkeypatch.setattr(c, "encode_words", lambda texts: [plain([x])[0][:-1] if x.endswith("again") else plain([x])[0] for x in texts])
    assert [(x[1], x[2] == y) for x, y in zip(c.check(t), t, strict=True)] == [(True, True), (False, False)]


def test_new_words_skip_the_pipeline(monkeypatch):
    """Each new word is a call of the library's model alone, and rare words don't keep frequent ones out."""
    monkeypatch.setattr(spm, "KEPT_WORDS", 20)
    c, ref = spm.Codec(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    monkeypatch.setattr(c, "encode_batch", None)
    t = [f"frequent w{i}é日 x{i}\n  y ▁z{i} " for i in range(100)] + [f"frequent w{i}é日" for i in range(200)] + ["", " ", "a  "]
    assert c.encode_words(t) == ref.encode(t)
    assert "frequent" in c.spaced and len(c.spaced) <= 20 and len(c.known) <= 20


def test_bytes_of_the_mark_stay_a_mark():
    c, ref = spm.Codec(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    mark = [ref.piece_to_id(f"<0x{b:02X}>") for b in spm.SPACE.encode()]
    ids = [ref.encode("a b") + mark + ref.encode("c"), mark, ref.encode(" a  b"), []]
    assert c.decode_batch(ids) == [ref.decode(i) if i else "" for i in ids]


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": ["a" * 400_000, None, "b" * 200_000, "c" * 2_000_000, "d"]})
    assert [p.num_rows for p in spm._slices(rows)] == [2, 1, 1, 1]


def message(pieces, trainer=b"", normalizer=b""):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    out = b""
    for p, score, kind in pieces:
        out += field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    return out + field(2, trainer) + field(3, normalizer)


def test_unigram_models():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("abab", -2.0, 1)]
    m = spm.Model.parse(message(pieces, bytes([3 << 3, 1, 40 << 3 & 0x7F | 0x80, 2, 0]), bytes([3 << 3, 1, 4 << 3, 1])))
    assert m.unigram and m.dummy_prefix and m.drop_extra_spaces and not m.byte_fallback
    t = m.tokenizer()
    assert t.encode("ab", add_special_tokens=False).ids == [2]
    assert t.encode(" abab  ab", add_special_tokens=False).tokens == ["▁", "abab", "▁ab"]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        spm.Model.parse(message([("<unk>", 0.0, 2)], bytes([3 << 3, 4])))


def test_report(spark, docs):
    ref = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    t = texts(60)
    rows = [(i, x) for i, x in enumerate(t)] + [(None, None), (3, "tie"), (3, "tie")]
    got = spm.report(docs(rows).selectExpr("*", "1 as ids", "2 as parity"), PIECE_BPE).collect()
    assert len(got) == len(rows) and all(r.parity for r in got)
    n = sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None)
    assert n == sorted((i, len(ref.encode(x or ""))) for i, x in rows if i is not None)
    assert spm.report(docs([]), PIECE_BPE).count() == 0
    coded = spm.decode(spm.encode(docs(rows[:20]), PIECE_BPE), PIECE_BPE).collect()
    assert all(r.decoded == ref.decode(ref.encode(r.text)) for r in coded)
