import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from cellspark.llm import packing as p
from tokenizers import Tokenizer


def optimum(sizes, capacity):
    """Fewest bins by dynamic programming over subsets."""
    best = [(0, 0)] + [None] * ((1 << len(sizes)) - 1)
    for done in range(1 << len(sizes)):
        bins, room = best[done]
        for i, s in enumerate(sizes):
            if not done >> i & 1:
                new = (bins, room - s) if s <= room else (bins + 1, capacity - s)
                at = done | 1 << i
                if best[at] is None or (new[0], -new[1]) < (best[at][0], -best[at][1]):
                    best[at] = new
    return best[-1][0]


def check(best, counts, capacity):
    held = Counter()
    for times, filling in best:
        assert times > 0 and sum(s * k for s, k in filling) <= capacity
        for s, k in filling:
            held[s] += times * k
    assert held == Counter(counts)
    return sum(t for t, _ in best)


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_optimal_on_small_cases():
    rng = random.Random(4)
    better = 0
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        sizes = [rng.randint(capacity // 8, capacity * 3 // 4) for _ in range(rng.randint(1, 11))]
        counts = Counter(sizes)
        n, greedy, best = check(p.solve(counts, capacity), counts, capacity), check(p.best_fit(counts, capacity), counts, capacity), optimum(sizes, capacity)
        assert n == best >= p.lower_bound(counts, capacity)
        assert greedy == plain_best_fit(sizes, capacity)
        better += n < greedy
    assert better > 0


def test_bin_completion_beats_best_fit():
    counts = Counter({44: 2, 8: 2, 24: 1, 17: 1, 22: 1, 21: 1, 6: 3})  # capacity 60
    case = Counter([6, 6, 4, 4, 3, 3, 2, 2])  # 30 in 3 sequences of 10
    assert check(p.solve(case, 10), case, 10) == 3
    assert check(p.solve(counts, 60), counts, 60) == optimum(sorted(counts.elements(), reverse=True), 60)
    # Best fit takes 3 sequences, two are enough; and the same a million times.
    case = Counter([4, 4, 3, 3, 3, 3])
    assert check(p.best_fit(case, 10), case, 10) == 3 and check(p.solve(case, 10), case, 10) == 2
    many = {s: 1_000_000 * n for s, n in case.items()}
    assert check(p.solve(many, 10), many, 10) == 2_000_000


def test_bounds_and_large_counts():
    assert p.lower_bound({6: 5}, 10) == 5 and p.lower_bound({6: 5, 4: 5, 5: 1}, 10) == 6
    rng = random.Random(1)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 4097)}
    assert check(p.solve(counts), counts, 4096) >= p.lower_bound(counts, 4096)
    assert p.solve({}) == [] and p.solve({5: 0}) == []
    assert check(p.solve({1366: 999_999}), {1366: 999_999}, 4096) == 500_000


def test_dominated_fillings_are_left_out():
    found = [sorted(dict(f).items()) for _, f in p.fillings({5: 1, 3: 2, 2: 2}, 6, 6, [1000])]
    assert [(3, 2)] in found and [(2, 2)] not in found
    assert not p._dominated([(3, 2)], 0, [2]) and p._dominated([(2, 2)], 2, [3])


def expected_pieces(rows, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, i, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "naïve", "code", "x1", "—", "日本"]) + rng.choice(["", ",", "!"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (None, "no id"), (None, "no id"), (5, rows[5][1]), (202, "very long " * 900)]


def test_pieces_and_places(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, extra columns; each sequence is filled without gaps and none is needless."""
    rows, capacity = corpus(), 64
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, piece string, length int")
    got = p.packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected_pieces(rows, capacity)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == p.lower_bound(Counter(r.length for r in got), capacity)
    folder = p.write_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/sequences", capacity)
    written = {r.sequence_id: r for r in spark.read.parquet(folder).collect()}
    places = {(r.sequence_id, r.offset): r for r in got}
    assert len(written) == len(sequences)
    for r in written.values():
        for part in r.parts:
            own = r.ids[4 * part.offset : 4 * (part.offset + part.length)]
            assert zlib.crc32(own) == places[r.sequence_id, part.offset].ids_crc32


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert p.packed(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
