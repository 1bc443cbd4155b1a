import random
from itertools import combinations

import corpus_pipeline
import numpy as np

from dialoom.llm import near_documents, similar, simhash


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def groups_by_hand(texts, threshold=0.8):
    """The smallest number each text is joined to, by comparing all."""
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def planted(seed=3, bases=40):
    """Texts and copies of them with a word or a few changed: similarities of about 0.6 to 0.97."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice((8, 30, 100, 300)))]
        texts.append(base)
        for _ in range(6):
            copy = list(rng.choice((base, texts[-1])))  # of a copy, too: chains
            for _ in range(rng.choice((1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    out = [" ".join(t) for t in texts]
    rng.shuffle(out)
    return [*out, "", "", "One two", "one TWO"]


def test_stage_finds_edited_copies(spark):
    texts = planted()
    want = groups_by_hand(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.different_documents(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want))


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a), (5, a + " end"), (5, b), (7, c), (7, c), (None, c + " end"), (None, "alone by itself"), (None, "alone by itself"), (9, None), (10, ""), (11, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.different_documents(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (7, c), (None, "alone by itself"), (9, None)], key=str)
    assert corpus_pipeline.different_documents(spark, docs.limit(0), "").count() == 0


def test_majority_equals_the_fingerprint():
    texts = ["one two three four five six seven"] * 3 + ["", "x " * 3000]
    h, of = near_documents.shingles(texts)
    whole = simhash.majority(h, of)
    assert (whole == simhash.majority(h, of, block=7)).all()
    for k in range(len(texts)):
        own = h[of == k]
        assert int(whole[k]) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > len(own))


def test_large_buckets_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART", 8)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    texts = planted(4, 12)[:-4]
    want = groups_by_hand(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    found = similar.similar_groups(rows.selectExpr("1L as key", "node"), rows.selectExpr("node", "0L as s0"), lambda nodes: rows.join(nodes, "node"), near_documents.shingles, 0.8, "test")
    label = {r.node: r.component for r in found.collect()}
    assert [label.get(i, i) for i in range(len(texts))] == want


def test_recall_of_bands_at_the_threshold():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(400):
        h = rng.integers(1 << 64, size=110, dtype=np.uint64)  # 90 of 110 are shared: 0.818
        keys, _ = near_documents.band_keys(np.r_[h[:100], h[:90], h[100:]], np.repeat([0, 1], 100))
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 2
