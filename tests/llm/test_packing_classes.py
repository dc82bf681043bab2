"""Harmonic classes: counts of documents in bins, pieces of documents, padding."""

import random
import struct
from collections import Counter

from matforge.llm import packing


def documents(n, seed, longest):
    r = random.Random(seed)
    sizes = [max(1, int(r.paretovariate(0.9) * 8) % longest) for _ in range(n)]
    return [packing.Piece(i, 0, k, struct.pack(f"<{k}I", *range(k)), k) for i, k in enumerate(sizes)]


def test_class_of():
    assert [packing.class_of(n, 12, 5) for n in (12, 7, 6, 5, 4, 3, 2, 1)] == [1, 1, 2, 2, 3, 4, 5, 5]


def test_bins():
    capacity, docs = 256, documents(4000, 3, 900)
    bins, sequences = packing.Bins(capacity, 16), []
    for d in docs:
        sequences += bins.add(d)
        assert sum(p.length for held in bins.open.values() for p in held) < 16 * capacity
    n_full = len(sequences)
    assert all(sum(p.length for p in seq) == capacity for seq in sequences)
    kinds = Counter()
    for seq in sequences:
        if seq[0].length == capacity:
            continue
        k = packing.class_of(seq[0].length, capacity, 16)
        if k < 16:  # k pieces of the class, and what fills the room
            own = [p for p in seq[:k] if packing.class_of(p.length, capacity, 16) == k]
            assert len(own) == k
        kinds[k] += 1
    assert {1, 2, 3, 5, 6, 7, 16} <= kinds.keys()
    rest = list(bins.rest())
    sizes = [sum(p.length for p in seq) for seq in rest]
    assert all(s & (s - 1) == 0 and s <= capacity for s in sizes) and len([s for s in sizes if s < capacity]) <= 8 and n_full > len(rest)
    seen = {d.doc: [] for d in docs}
    for seq in sequences + rest:
        for p in seq:
            assert p.raw == struct.pack(f"<{p.length}I", *range(p.start, p.start + p.length))
            seen[p.doc].append((p.start, p.length))
    for d in docs:
        at = 0
        for start, n in sorted(seen[d.doc]):
            assert start == at
            at += n
        assert at == d.length
    pieces = sum(map(len, seen.values()))
    assert pieces < len(docs) + 2 * len(sequences + rest)
