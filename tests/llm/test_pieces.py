"""The agenda against the sentencepiece library, text by text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomery.llm import piece_bpe
from loomery.llm.piece_bpe import SPACE, PieceModel, decode_ids, encode_texts
from loomery.llm.plans import op11_piece_encoding

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "the the", "x" * 5000, "word " * 4000, "日本語テキスト 日本語", "İstanbul ß ½² a²b 12345 3.14", "tab\tnew\nline\r\n", "▁a▁▁b ▁", "a b c",
    "\x00\x1c end", "😀👍🏽 ok", "é ́", "¿Qué?¡!", "<s></s><unk><0x0A>", "﻿bom �", "a.b,c;d\n\n-- {x}", "the", "the", "9" * 300,
]
ALPHABET = "abcdefghijTHE  ▁\n\té²ß日𝄞́\x00İ.,'019_"


def ids_of(t):
    return LIBRARY.encode(t or "") + [2]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i, t, "x", [1]) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ids array<int>").repartition(3)


def test_ids_and_texts_equal_the_library(odd):
    got = {r.doc_id: r for r in encode_texts(odd, PATH).collect()}
    for i, t in enumerate(ODD):
        r = got[None if i == 3 else i]
        assert (r.ids, r.decoded) == (ids_of(t), LIBRARY.decode(ids_of(t))), t
    assert [r.ids for r in encode_texts(odd, PATH, end=False).filter("doc_id = 1").collect()] == [[]]
    assert encode_texts(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("cuts", [True, False])
def test_random_texts(cuts):
    m, rnd = PieceModel(PATH), random.Random(4)
    assert m.cuts
    if not cuts:
        m.cuts, m.chunks = False, lambda t: [t]
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([0, 3, 20, 300]))) for _ in range(800)]
    stream, sizes, strange = piece_bpe._encode_slice(pa.array(texts), m, piece_bpe._Known(), np.array([2], "<i4"))
    ends = np.cumsum(sizes)
    assert [stream[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [ids_of(t) for t in texts] and not strange


def test_heaps_and_blocks_agree():
    m, rnd = PieceModel(PATH), random.Random(6)
    chunks = [SPACE + "".join(rnd.choice("abcdeést日") for _ in range(rnd.randrange(1, 200))) for _ in range(300)] + [SPACE * k for k in range(1, 40)]
    assert [np.frombuffer(x, "<i4").tolist() for x in m.encode_all(chunks)] == [m.encode(c) for c in chunks]


def test_ties_go_left():
    m = PieceModel(PATH)
    m.rank = {"aa": 1, "ab": 1, "aab": 1}
    m.ids = {"a": 5, "b": 6, "aa": 7, "ab": 8, "aab": 9}
    m._pairs()
    assert m.symbols("aaab") == ["aa", "ab"] and m.symbols("aab") == ["aab"]
    assert np.frombuffer(m.encode_all(["aaab"])[0], "<i4").tolist() == [7, 8]


def test_decoding_equals_the_library(spark):
    rnd = random.Random(5)
    lists = [[rnd.choice([rnd.randrange(259), rnd.randrange(32_000), 29871, 0, 1, 2]) for _ in range(rnd.randrange(9))] for _ in range(1500)]
    rows = [(i, x) for i, x in enumerate(lists)] + [(-1, None)]
    got = {r.doc_id: r.text for r in decode_ids(spark.createDataFrame(rows, "doc_id int, ids array<int>"), PATH).collect()}
    assert got.pop(-1) == "" and got == {i: LIBRARY.decode(x) for i, x in enumerate(lists)}


def test_other_vocabularies_are_refused(odd, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as layout

    proto = layout.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        encode_texts(odd, f"{tmp_path}/other.model")


def test_query_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(r.doc_id, len(ids_of(r.text)), sha(" ".join(map(str, ids_of(r.text)))), sha(LIBRARY.decode(ids_of(r.text)))) for r in docs}
    assert {tuple(r) for r in op11_piece_encoding.query(spark, sf).collect()} == want
