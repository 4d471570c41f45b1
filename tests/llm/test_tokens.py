"""Token counts and token files against the library, text by text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomery.llm import token_files, words
from loomery.llm.plans import op7_arrow_tokens, op9_token_counts
from loomery.llm.token_counts import shortcut_holds, with_token_counts
from loomery.llm.token_files import SequenceReader, read_documents, read_sequences, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "the", "The THE don't we'll x's ''s !'s 'S 12345 a1b2", "<|endoftext|> x<|startoftext|>y <|endoftext|", "é É ß İstanbul ΣΑΣ ﬁ 日本語テキスト ａｂｃ",
    "a b c\u0085d​e﻿", "école cafés", "x" * 5000, "word " * 3000, "😀👍🏽 ok\x00\x1c\x1f end", "́start", "½ ² ٣ Ⅷ", "tab\tnew\nline\rfeed\x0c\x0b", "the", "the",
    "JH\u0331 naT\u0308 plain", "H\u0331", "T\u0308", "J\u030c", "W\u030a", "Y\u030a", "ÀÉÎ ABC\u0301D ẞİ ΑΣ AΣ", "A\u030aNGSTRO\u0308M",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")


LIBRARY = Tokenizer.from_file(PATH)


def _ids(t):
    return LIBRARY.encode(t or "", add_special_tokens=False).ids


def test_counts_equal_the_library(odd):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in with_token_counts(odd, PATH).collect()}
    assert got == {(None if i == 3 else i): (len((t or "").encode()), len(_ids(t))) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_counted_by_their_library(odd, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    got = {r.doc_id: r.n_tokens for r in with_token_counts(odd, path).collect()}
    assert got == {(None if i == 3 else i): count(t or "") for i, t in enumerate(ODD)}
    assert shortcut_holds(PATH) and not shortcut_holds(path)
    with pytest.raises(ValueError):
        write_token_files(odd, path, 2, 50_257)


def test_counts_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = op9_token_counts.query(spark, sf).toPandas().set_index("doc_id")
    for r in docs.itertuples():
        assert got.n_tokens[r.doc_id] == len(_ids(r.text)), r.doc_id
    assert (got.over_limit == (got.n_tokens > 2048)).all()


def test_files_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = op7_arrow_tokens.query(spark, sf).toPandas().set_index("doc_id")
    start = 0
    for r in docs.itertuples():
        ids = [*_ids(r.text), 2]
        assert tuple(got.loc[r.doc_id]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        start += len(ids)


def test_odd_rows_in_several_shards(odd, spark):
    manifest = write_token_files(odd.repartition(3), PATH, 2, 49408, length=16, shards=4)
    got = {(r.doc_id): r for r in read_documents(manifest).collect()}
    start = 0
    for i in [3, *(k for k in range(len(ODD)) if k != 3)]:
        ids = [*_ids(ODD[i]), 2]
        r = got[None if i == 3 else i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    rows = manifest.orderBy("base").collect()
    assert len(rows) > 1 and sum(r.n_tokens for r in rows) == start
    reader = SequenceReader(rows[0].path)
    flat = reader.ids()
    for k in range(len(reader)):
        ids, mask = reader.sequence(k)
        on = mask.to_numpy(zero_copy_only=False)
        assert len(ids) == len(mask) == 16 and mask.type == "bool" and ids.base is not None and (ids[on] == flat[k * 16 : k * 16 + 16]).all()
    assert read_sequences(spark, manifest).count() == sum(len(SequenceReader(r.path)) for r in rows)


def test_capitals_with_marks_and_many_files(spark, monkeypatch):
    rnd = random.Random(8)
    letters = "HTJWYAEIOUSZhtjwyaeiou  " + "\u0300\u0301\u0308\u030a\u030c\u0331\u0323" * 2
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    # A task that closes a file after each slice.
    monkeypatch.setattr(token_files, "SHARD_IDS", 1)
    monkeypatch.setattr(words, "slices", lambda batch, column, most=0: (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)))
    manifest = write_token_files(df, PATH, 2, 49408, length=16, shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_documents(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*_ids(t), 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert manifest.count() > 6


def test_wide_ids_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    rows = write_token_files(df, PATH, 70_000, 49408, length=4).collect()
    assert SequenceReader(rows[0].path).file.schema.field("ids").type.value_type.bit_width == 32
    assert read_documents(write_token_files(df, PATH, 2, 49408)).count() == 3


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert with_token_counts(none, PATH).count() == 0
    assert read_documents(write_token_files(none, PATH, 2, 49408)).count() == 0
