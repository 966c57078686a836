import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from assaykit.llm.packing import Encoder, binary_lengths, pack_documents, public_tokenizer, packed_rows

ODD = ["", None, " ", "a", "  a  b ", "a \n b\n\nc", "x y z", "a\t b", "<|endoftext|> a<|endoftext|>b", "it's  we'll 'S", "ünï 漢字 12 3.4", "a\x1c b \x85c", "w " * 700, "q" * 3000, "👍 ok\r\n", "a b", " lead", "trail "]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(text):
    path = public_tokenizer()
    whole = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    with open(path) as f:
        encoder = Encoder(f.read())
    assert encoder.fast is not None
    for encoder.fast in (encoder.fast, None):
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == whole


def test_ids_over_a_table(spark):
    path = public_tokenizer()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [" " * 300_000 + "x", "\n \t" * 9999, "z" * 100_000]
    tokenizer = Tokenizer.from_file(path)
    with open(path) as f:
        encoder = Encoder(f.read())
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_lengths(n):
    got = binary_lengths(n, 1024)
    assert sum(got) == n and got == sorted(got, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 1024 for x in got)
    assert len([x for x in got if x < 1024]) == len({x for x in got if x < 1024})


def test_round_trip(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(3, "a", 9), (None, "b c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = pack_documents(docs, public_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(public_tokenizer())
    for i, t in enumerate(ODD):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        if i == 3:
            own = own[::2]
        assert np.frombuffer(b"".join(bytes(r.ids_le) for r in own), "<u4").tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own][:-1]]).tolist()
        assert all(r.doc_tokens == len(ids) and r.length == 1 << r.bucket and r.offset == 0 for r in own)
    assert len({r.sequence_id for r in got}) == len(got)
    assert sum(r.doc_id is None for r in got) == 2
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packed_rows(docs).collect()}
    assert all(zlib.crc32(bytes(r.ids_le)) == digest[r.doc_id, r.start] for r in got)


def test_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), public_tokenizer()).count() == 0
