"""The registered packing takes added tokens in a text as the tokenizers library does by default."""

from __future__ import annotations

import zlib

import public_tokenizers
from tokenizers import Tokenizer

from seedlake.llm import registry

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "<|endoftext| >", "plain", None]


def test_added_tokens(spark, tmp_path):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in registry.op7_best_fit_packing(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i].length, rows[i].ids_crc32) == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
