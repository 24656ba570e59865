"""Alignment in bits against a plain table."""

import random

from cellspark.llm.decontaminate import is_within, places_of


def least_edits(item, region):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in region:
        new = [0]
        for i, b in enumerate(item):
            new.append(min(row[i] + (b != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_alignment_in_bits_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        part = bytearray(item)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(part) + 1)
            part[at : at + rng.randint(0, 1)] = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 1)))
        region = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20))) + bytes(part) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
        d = least_edits(item, region)
        assert [is_within(places_of(item), len(item), region, e) for e in range(d + 3)] == [e >= d for e in range(d + 3)]
