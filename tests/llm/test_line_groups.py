import random
from itertools import combinations

import numpy as np

from dialoom.llm import line_dedup, similar


def shingle_set(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def groups_by_hand(lines, threshold=0.8):
    """The smallest number each line is joined to, by comparing all."""
    sets, label = [shingle_set(x) for x in lines], list(range(len(lines)))
    for i, j in combinations(range(len(lines)), 2):
        if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def chains(seed=5, templates=4, steps=25):
    """Lines that drift from a template, a letter at a time: neighbours are similar, ends are not."""
    rng, out = random.Random(seed), []
    for _ in range(templates):
        line = rng.choices("abcdefghijklmnop", k=rng.choice((90, 140, 200)))
        for _ in range(steps):
            out.append("".join(line))
            line = list(line)
            line[rng.randrange(len(line))] = rng.choice("qrstuvwxyz")
    rng.shuffle(out)
    return out


def grouped(spark, texts):
    """near_lines where all lines share the first bucket, and sketches leave all of them in."""
    names = [f"b{k}" for k in range(line_dedup.BANDS)]
    rows = [(i, t, *[1 if k == 0 else 0 for k in range(line_dedup.BANDS)]) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "id long, norm string, " + ", ".join(f"{k} long" for k in names))
    label = {r.node: r.component for r in line_dedup.near_lines(lines, lines.drop("norm")).collect()}
    return [label.get(i, i) for i in range(len(texts))]


def test_a_line_meets_those_that_joined_another(spark):
    x = "".join(random.Random(1).choices("abcdefghijklmnop", k=100))
    r, y = "#" + x[1:50] + "#" + x[51:], x[:75] + "#" + x[76:99] + "#"  # r-x and x-y are similar, r-y is not
    assert groups_by_hand([r, x]) == groups_by_hand([x, y]) == [0, 0] and groups_by_hand([r, y]) == [0, 1]
    assert grouped(spark, [r, x, y]) == [0, 0, 0]


def test_groups_equal_brute_force(spark, monkeypatch):
    texts = chains()
    assert grouped(spark, texts) == groups_by_hand(texts)
    monkeypatch.setattr(similar, "PART", 8)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    assert grouped(spark, texts) == groups_by_hand(texts)


def test_recall_of_bands_for_short_lines():
    rng = random.Random(7)
    for n, cut in ((25, 2), (43, 4), (70, 7)):
        pairs = []
        for _ in range(1500):
            x = "".join(rng.choices("abcdefghijklmnop", k=n))
            pairs += [x, x[:-cut] + "".join(rng.choices("qrstuvwxyz", k=cut))]
        one, two = shingle_set(pairs[0]), shingle_set(pairs[1])
        assert len(one & two) >= 0.8 * len(one | two)
        keys = line_dedup.bands(line_dedup.minima(pairs))
        assert ((keys[::2] == keys[1::2]) & (keys[::2] != 0)).any(axis=1).mean() >= 0.99


def test_sketches_of_similar_lines_are_promising():
    rng = random.Random(9)
    for n in (60, 150, 400):
        pairs = []
        while len(pairs) < 800:
            x = rng.choices("abcdefghijklmnop", k=n)
            y = list(x)
            while True:
                z = list(y)
                z[rng.randrange(n)] = "q"
                a, b = shingle_set("".join(x)), shingle_set("".join(z))
                if len(a & b) < 0.8 * len(a | b):
                    break
                y = z
            pairs += ["".join(x), "".join(y)]
        s = line_dedup.bands(line_dedup.minima(pairs)).view("<u2")
        assert similar._alike(s[::2], s[1::2], 0.8).all()


def test_small_units_equal_matrices():
    rng = random.Random(3)
    lines = chains(11, 3, 4)
    h, of = line_dedup.line_shingles(lines)
    unit = np.repeat([0, 1, 2], 4)
    i, j = similar.small_pairs(h, of, unit, 0.8)
    every = np.arange(len(lines))
    a, b = similar.similar_pairs(h, of, every, every, 0.8)
    assert {(x, y) for x, y in zip(i.tolist(), j.tolist())} == {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x < y and unit[x] == unit[y]}
    assert rng and len(i)


def drifting(seed, count=20, steps=40):
    """Chains of lines of which each differs from the one before by a word."""
    rng, out = random.Random(seed), []
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    for _ in range(count):
        line = rng.choices(words, k=24)
        for _ in range(steps):
            out.append(" ".join(line))
            line = list(line)
            line[rng.randrange(len(line))] = rng.choice(words)
    rng.shuffle(out)
    return out


def test_chains_lose_no_link(spark):
    texts = drifting(21)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.line_dedup(docs).where("n_removed = 0").collect()}
    want = set(groups_by_hand(texts))
    assert want <= got and len(got - want) <= len(want) // 100


def test_lines_that_share_an_id(spark):
    rows = [(1, 5, 0, 7, 1, "one line"), (2, 6, 0, 7, 2, "another line"), (3, 7, 0, 7, 1, "one line")]
    names = [f"b{k}" for k in range(line_dedup.BANDS)]
    lines = spark.createDataFrame([(*r, *[r[4]] * line_dedup.BANDS) for r in rows], "doc long, th long, pos int, id long, other long, norm string, " + ", ".join(f"{k} long" for k in names))
    table, known = line_dedup._told_apart(lines)
    assert sorted(r.n for r in known.collect()) == [1, 2] and table.select("id").distinct().count() == 2


def test_line_dedup_equals_brute_force_at_its_threshold(spark):
    texts = chains(8, 3, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.8, 0.95):
        want = groups_by_hand(texts, threshold)
        got = line_dedup.line_dedup(docs, threshold=threshold).where("n_removed = 0").collect()
        assert sorted(r.doc_id for r in got) == sorted(set(want))


def test_only_sketches_of_candidates_are_joined(spark, monkeypatch):
    asked, promising = [], similar._promising
    monkeypatch.setattr(similar, "_promising", lambda units, sketches, threshold: asked.append({r.node for r in sketches.collect()}) or promising(units, sketches, threshold))
    texts = ["a line of its own, that no other line is like", "one of two lines that are nearly the same as the other", "one of two lines that are nearly the same as the others"]
    members = spark.createDataFrame([(5, 0), (6, 1), (6, 2), (7, 2)], "key long, node long")
    sketches = spark.createDataFrame([(i, 1) for i in range(3)], "node long, b0 long")
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = similar.similar_groups(members, sketches, lambda needed: rows.join(needed, "node"), line_dedup.line_shingles, 0.8, "few")
    assert [(r.node, r.component) for r in found.collect()] == [(2, 1)] and asked == [{1, 2}]
