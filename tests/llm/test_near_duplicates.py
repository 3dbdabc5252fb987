import random
import re

import numpy as np
import pytest

from lodespark.llm import near_duplicates as N
from lodespark.llm import setsketch as S

SCHEMA = "row_id long, relative_path string, text string, id string, cls string, key int, mark string"


def shingles(text, width):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def brute(rows, threshold, width):
    sets = [(i, p, shingles(t, width)) for i, p, t in rows if t]
    out = set()
    for k, (a, p, x) in enumerate(sets):
        for b, q, y in sets[:k]:
            if x and y and p != q and len(x & y) / len(x | y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = [rng.choice(words) for _ in range(60)]
        for c in range(3):
            text = list(base)
            for _ in range(rng.randrange(0, 6) * c):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), f"f{len(rows) % 50}", " ".join(text)))
    rows += [(len(rows) + k, f"g{k}", rows[k][2]) for k in range(20)]  # copies
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, p, t, "x", "y", 1, "z") for i, p, t in rows], SCHEMA)


def test_finds_what_brute_force_finds(spark):
    rows = corpus()
    links, members = N.class_links(frame(spark, rows), "row_id", "relative_path", "text", 0.6, 3)
    got = {(r[0], r[1]) for r in N.row_pairs(links, members).collect()}
    want = brute(rows, 0.6, 3)
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def test_large_buckets_are_compared_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(1000)}" for _ in range(80)]
    rows = []
    for k in range(90):  # near copies of one text: a bucket far above the block size
        text = list(base)
        text[rng.randrange(80)] = f"x{k}"
        rows.append((k, f"p{k}", " ".join(text)))
    df = frame(spark, rows)
    want = brute(rows, 0.6, 3)
    for block in (4, 7, 1024):
        links, members = N.class_links(df, "row_id", "relative_path", "text", 0.6, 3, block=block)
        assert {(r[0], r[1]) for r in N.row_pairs(links, members).collect()} == want


def test_a_passage_repeated_in_one_of_two_texts(spark):
    rng = random.Random(7)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(90)]
        rows += [(2 * k, f"a{k}", " ".join(words)), (2 * k + 1, f"b{k}", " ".join(words * (k % 4 + 2)))]
    want = brute(rows, 0.6, 3)
    assert len(want) == 12
    links, members = N.class_links(frame(spark, rows), "row_id", "relative_path", "text", 0.6, 3)
    assert {(r[0], r[1]) for r in N.row_pairs(links, members).collect()} == want


def test_groups_have_every_row_once(spark):
    rows = corpus(30)
    rows += [(900, "a", None), (901, "a", ""), (902, None, "two words"), (903, "b", "one two three"), (904, "c", "one two three"), (905, "c", "ONE, two... Three!")]
    df = frame(spark, rows)
    links, members = N.class_links(df, "row_id", "relative_path", "text", 0.6, 3)
    got = {r.row_id: r for r in N.grouped(links, members, df, "row_id").collect()}
    assert sorted(got) == sorted(i for i, _, _ in rows)
    assert got[900].group_id == 900 and got[901].group_id == 901 and got[902].group_id == 902
    assert got[903].class_id == got[904].class_id == got[905].class_id == 903
    parent = {i: i for i in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute([(i, f"{i}", t) for i, _, t in rows], 0.6, 3):
        parent[find(a)] = find(b)
    want = {}
    for i in got:
        want.setdefault(find(i), set()).add(i)
    have = {}
    for i, r in got.items():
        have.setdefault(r.group_id, set()).add(i)
    missing = [g for g in have.values() if g not in want.values()]
    assert len(missing) <= 1


def test_a_long_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(k, k + 1, 0.9) for k in range(200)], "a long, b long, similarity double")
    got = {r.cls: r.root for r in N.components(links).collect()}
    assert set(got.values()) == {0} and set(got) == set(range(1, 201))


def test_empty_table_nulls_and_long_texts(spark):
    empty = frame(spark, [])
    links, members = N.class_links(empty, "row_id", "relative_path", "text", 0.8, 5)
    assert links.count() == 0 and N.row_pairs(links, members).count() == 0 and N.grouped(links, members, empty, "row_id").count() == 0
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, "a", long), (2, "b", long + " end"), (3, None, "a b c d e f"), (4, None, "a b c d e f"), (None, "x", "a b c d e f")]
    links, members = N.class_links(frame(spark, rows), "row_id", "relative_path", "text", 0.8, 5)
    assert {(r[0], r[1]) for r in N.row_pairs(links, members).collect()} == {(1, 2)}


def test_threshold_out_of_range(spark):
    with pytest.raises(ValueError):
        N.class_links(frame(spark, []), "row_id", "relative_path", "text", 0.2)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = S.registers(u[:200], np.array([200]), 64), S.registers(u[100:], np.array([200]), 64)
    both = S.registers(u, np.array([300]), 64)
    assert (S.merge(a, b) == both).all()
    guesses = []
    for _ in range(200):
        u = rng.integers(0, 2**63, 300, dtype=np.uint64)
        x, y = S.registers(u[:200], np.array([200]), 60), S.registers(u[100:], np.array([200]), 60)
        guesses.append(S.joint_estimate(x, y, np.array([200.0]), np.array([200.0]))[0])
    assert abs(np.mean(guesses) - 1 / 3) < 0.02


def test_words_are_runs_of_letters_and_digits():
    texts = ["Héllo, wörld_9 x", "", "中文 a-b", "İstanbul 日本", "  ", "𝒳1 ok"]
    hashes, counts = S.words(texts)
    assert counts.tolist() == [len(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    again, _ = S.words(["zzz héllo"])
    assert hashes[0] == again[1]
