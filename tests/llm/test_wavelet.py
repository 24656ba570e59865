import zlib

import numpy as np
import public_tokenizers
import pytest
from cellspark.llm import wavelet
from cellspark.llm.wavelet import WaveletMatrix
from tokenizers import Tokenizer

PATH = public_tokenizers.path(wavelet.VOCABULARY)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (64, 3), (65, 49_408), (1000, 20), (3001, 49_408)])
def test_rank_select_access(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    wm = WaveletMatrix.build(ids)
    assert wm.to_ids().tolist() == ids.tolist()
    if n:
        at = rng.integers(0, n, 50)
        assert wm.access(at).tolist() == ids[at].tolist()
    for token in [*ids[:5].tolist(), top + 1]:
        where = np.flatnonzero(ids == token)
        assert wm.count(token) == len(where)
        assert wm.rank(token, n // 2) == (ids[: n // 2] == token).sum()
        assert [wm.select(token, k) for k in range(min(len(where), 4))] == where[:4].tolist()
        assert wm.select(token, len(where)) == -1


def test_file_round_trip():
    ids = np.array([5, 1, 5, 49_407, 1])
    docs, starts, wm = wavelet.from_file(wavelet.to_file(np.array([7, 9]), np.array([0, 2]), ids))
    assert (docs.tolist(), starts.tolist(), wm.to_ids().tolist()) == ([7, 9], [0, 2], ids.tolist())
    with pytest.raises(ValueError):
        wavelet.from_file(wavelet.to_file(np.array([7]), np.array([0]), ids)[:-1])


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_same_as_library(spark, shard_bytes):
    texts = [None, "", " \n ", "I'll GO\tthere  now 'so' 's", "x" * 500, "Ünïcödé 日本語 İ ΟΔΟΣ Σ 123", "é a ́b c", "see <|endoftext|> and<|startoftext|>x", "it's " * 60, "??!! don't's　x\x1cy"]
    texts += ["ÉÀß éàÿ øØ'Ll ×÷ naïve'd [a]#1_2", "ª º µ ½ ² é", "E\u0301a"]
    texts += [f"word{i} and {i * 7919} more" for i in range(60)]
    rows = [(None if i == 4 else 1000 - i, t, "x") for i, t in enumerate(texts)] + [(3, "twice", "a"), (3, "twice", "b")]
    tok = Tokenizer.from_file(PATH)
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder, shards = wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string"), PATH, shard_bytes=shard_bytes)
    got = sorted((tuple(r) for r in wavelet.read_shards(spark, folder, shards).collect()), key=lambda r: r[1])
    assert got == expected


def test_empty_table(spark):
    folder, shards = wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert wavelet.read_shards(spark, folder, shards).count() == 0


def test_lookup_inflates_few_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 1 << 10)
    ids = np.random.default_rng(5).zipf(1.3, 5 * 1024 + 77).clip(max=60_000).astype("<u2")
    data = wavelet.to_file(np.array([7]), np.array([0]), ids)
    for at in (0, 1023, 1024, 3000, len(ids) - 1):
        wm = wavelet.from_file(data)[2]
        assert wm.access(at).tolist() == [ids[at]]
        assert len(wm.held) == wm.bits == 16
    wm = wavelet.from_file(data)[2]
    assert (wm.access(np.arange(len(ids))) == ids).all() and (wm.to_ids() == ids).all()
    for token in (1, 2, 3, 60_000, 59_999, 70_000):
        places = np.flatnonzero(ids == token)
        assert wm.count(token) == len(places)
        assert wm.positions(token).tolist() == places.tolist()
        assert wm.positions(token, 3, 9).tolist() == places[3:9].tolist()
        assert [wm.select(token, k) for k in (-1, 0, len(places))] == [-1, places[0] if len(places) else -1, -1]
        assert wm.rank(token, 2048) == (ids[:2048] == token).sum()


def test_whole_blocks_and_no_ids(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 1 << 10)
    ids = np.arange(2048, dtype="<u2") % 5
    wm = wavelet.from_file(wavelet.to_file(np.array([7]), np.array([0]), ids))[2]
    assert wm.count(4) == 409 and wm.select(4, 408) == 2044 and (wm.to_ids() == ids).all()
    assert WaveletMatrix.build(np.zeros(0, "<u2"), 16).count(3) == 0


def test_occurrences(spark):
    docs = spark.createDataFrame([(3, "one two one"), (None, "two"), (1, ""), (2, None)], "doc_id long, text string")
    folder, shards = wavelet.write_shards(docs, PATH, shard_bytes=8)
    one, two = (int(np.frombuffer(wavelet.tokenize_text(w, PATH), "<u2")[0]) for w in ("one", "two"))
    found = {tuple(r) for r in wavelet.occurrences(spark, folder, [one, two, 49_000]).collect()}
    assert found == {(one, 3, 0), (two, 3, 1), (one, 3, 2), (two, None, 0)}
