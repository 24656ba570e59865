import hashlib

import numpy as np
import public_tokenizers
import pytest
from cellspark.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


def expected(text):
    enc = bpe.encoder(PATH, public_tokenizers.PATTERN)
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (40, 8), (7, 3)])
def test_same_as_whole_text_encoding(spark, chunk, overlap):
    texts = [None, "", " ", "  \n\n x", "I'll go\tthere  now 'so'", "x" * 500, "it's " * 60 + "  \n\t  end   ", "Ünïcödé 日本語 text 123 4567!!", "a b  c\x1cd", "é" * 90 + " tail", "??!! '' 's't 're", " ".join(f"w{i}\n" * (i % 3 + 1) for i in range(200))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, texts[6], None), (None, "z", None), (6, texts[6], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.digests(df, chunk_chars=chunk, overlap=overlap).collect()), key=str)
    assert got == sorted(((i, *expected(t)) for i, t, _ in rows), key=str)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
