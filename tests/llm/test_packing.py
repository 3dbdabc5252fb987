import random

import numpy as np

from lodespark.llm import packing as P
from lodespark.llm import tokens


class Slow:
    """The rule tried out gap by gap."""

    def __init__(self, capacity):
        self.capacity, self.count = capacity, {}

    def place(self, size):
        def cost(gap):
            n = dict(self.count)
            if gap != self.capacity:
                n[gap] -= 1
            if gap - size:
                n[gap - size] = n.get(gap - size, 0) + 1
            return sum(v * v for v in n.values())

        options = [g for g, n in sorted(self.count.items()) if n and g >= size]
        best = min([(cost(g), k, g) for k, g in enumerate(options)] + [(cost(self.capacity), len(options), self.capacity)])
        gap = best[2]
        if gap != self.capacity:
            self.count[gap] -= 1
        if gap - size:
            self.count[gap - size] = self.count.get(gap - size, 0) + 1
        return self.capacity - gap


def test_places_where_the_sum_of_squares_is_least():
    rng = random.Random(3)
    for capacity in (7, 20, 50):
        fast, slow = P.Packer(capacity), Slow(capacity)
        for _ in range(400):
            size = rng.randrange(1, capacity + 1)
            assert fast.place(size)[2] == slow.place(size)


def test_sequences_are_whole_and_full():
    rng = np.random.default_rng(1)
    packer, at = P.Packer(2048), {}
    sizes = np.minimum(rng.lognormal(5.5, 0.8, 20_000).astype(int) + 1, 2048)
    for size in sizes.tolist():
        s, position, offset = packer.place(size)
        have = at.setdefault(s, [0, 0])
        assert have == [position, offset]
        have[0], have[1] = have[0] + 1, have[1] + size
        assert have[1] <= 2048
    assert sizes.sum() / (packer.sequences * 2048) > 0.99


def test_pieces():
    assert P.pieces(5, 10) == [(0, 5)] and P.pieces(20, 10) == [(0, 10), (10, 10)] and P.pieces(21, 10) == [(0, 10), (10, 10), (20, 1)]


def test_tables(spark):
    schema = "doc_id long, text string, tokens string, sequence_id string, h string"
    rows = [(k, "some words of a text " * (k % 50 + 1), "", "", "") for k in range(300)] + [(1000, None, "", "", ""), (1001, "", "", "", ""), (1002, "long text " * 30_000, "", "", ""), (5, "some words", "", "", ""), (None, "no id here", "", "", "")]
    df = spark.createDataFrame(rows, schema)
    out = P.packed(df, 256).collect()
    sizes = {(i, t): len(tokens.encoding().encode_ordinary(t)) for i, t, *_ in rows if t}
    assert sum(r.tokens for r in out) == sum(sizes.values())
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [r.offset for r in own] == [sum(x.tokens for x in own[:k]) for k in range(len(own))]
        assert sum(r.tokens for r in own) <= 256
    assert not {1000, 1001} & {r.doc_id for r in out}
    report = P.fill(P.packed(df, 256), 256).first()
    assert report.tokens == sum(sizes.values()) and report.sequences == len(by) and report.unused == len(by) * 256 - report.tokens
    empty = P.fill(P.packed(df.limit(0), 256), 256).first()
    assert (empty.documents, empty.sequences, empty.tokens, empty.filled) == (0, 0, 0, None)
