"""Ids of texts that hold an added token, against a tokenizer loaded from the file as it is."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y é", "日本<|endoftext|>", "a <|endoftext| > b", "plain words"]


def fresh():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_added_tokens_are_one_id():
    machine = fresh()
    for text, data in zip(TEXTS, packing.token_bytes(TEXTS), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == machine.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.token_bytes(TEXTS[:1])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_packed_pieces_have_the_files_ids(spark):
    machine = fresh()
    rows = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for d, text in enumerate(TEXTS):
        ids = [*machine.encode(text, add_special_tokens=False).ids, packing.END]
        assert (rows[d].doc_tokens, rows[d].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
