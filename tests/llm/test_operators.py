import hashlib
import time
import zlib
from collections import Counter
from dataclasses import replace
from itertools import product

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from dialoom.llm import bk_tree, column_bwt, common, embedding_dedup, exact_dedup, line_dedup, mixing, packing, passages, quality, simhash, token_files, tokens, toxicity

DOCS = "doc_id long, text string, lang string, id long, norm string, th string"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "ze") for b in ("ta", "lu", "mi") for c in ("n", "r", "s", "")]


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (4, "one"), (None, "two words"), (6, text(1, 30_000)), (7, text(2, 80)), (8, text(2, 80) + " end"), (9, "ÀB\tc\x0b d")]


def brute_components(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(70, 90)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute_components(91, links)
    assert all(got.get(i, i) == want[i] for i in range(91))


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, tmp_path, bits):
    rows = [*ODD, *[(100 + i, f"Text {i % 40}" if i % 2 else f"tEXT {i % 40}") for i in range(200)]]
    table(spark, rows).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.exact_dedup(spark, str(tmp_path / "d"), bits=bits).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = Counter((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_dedup_takes_in_new_files(spark, tmp_path):
    path = str(tmp_path / "d")
    table(spark, [(1, "a"), (2, "b")]).write.parquet(path)
    d = exact_dedup.StreamingDedup(spark, path)
    d.update()
    table(spark, [(3, "A")]).write.mode("append").parquet(path)
    d.update()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in d.resolve().collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


def test_bk_forest():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 10, 300).astype(np.uint64)
    shard = np.sort(rng.integers(0, 5, 300))
    got = {(int(a), int(b)) for q, m in bk_tree.Forest(items, shard).search(items, shard, 2) for a, b in zip(q, m, strict=True)}
    assert got == {(a, b) for a in range(300) for b in range(300) if shard[a] == shard[b] and bin(int(items[a] ^ items[b])).count("1") <= 2}


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    rows = [*ODD, *[(20 + i, text(50, 120) + f" tail{i}") for i in range(30)]]
    got = simhash.simhash_query(table(spark, rows)).collect()
    fp = [slow_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4]
    label = brute_components(len(rows), links)
    low = {k: min((rows[j][0] for j in range(len(rows)) if label[j] == k and rows[j][0] is not None), default=None) for k in label}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((rows[i][0], f"{fp[i]:016x}", low[label[i]]) for i in range(len(rows)))


def test_large_shards_in_parts(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 12, (400, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    got = {r.node: r.component for r in common.components(simhash.near_links(nodes, 4, part=8)).collect()}
    want = brute_components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_tokens_equal_the_tokenizer():
    t = Tokenizer.from_file(tokens.tokenizer_path())
    e = tokens.Encoder(most=5)
    for s in ["", " ", "a b", "a  b\n\n c ", "it's\nI'll", "<|endoftext|> x", "a b c", "　x", text(3, 50), "é" * 40, "x\ty", "\n", "naïve\nword 12 34"]:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def check_packed(rows, got, limits):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    ids = Counter(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, x in rows)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= (limits.segments or 1 << 30) and sum(p.loss_tokens for p in pieces) <= (limits.loss or 1 << 30)
    assert sum(r.length for r in got) == sum(len(k) // 4 * n for k, n in ids.items())
    return by_sequence


def test_packing(spark):
    limits = packing.Limits(64, 4, 40)
    rows = [*ODD, *[(100 + i, text(i, 1 + i % 70)) for i in range(120)]]
    got = packing.pack(table(spark, rows).coalesce(1), limits, loss_of=lambda _, ids: np.arange(len(ids)) % 2 == 0, pool=16).collect()
    check_packed(rows, got, limits)
    full = packing.pack(table(spark, rows).coalesce(1), packing.Limits(64)).collect()
    sequences = check_packed(rows, full, packing.Limits(64))
    assert sum(r.length for r in full) > 64 * (len(sequences) - 1)
    one = next(r for r in full if r.doc_id == 7 and r.start == 0)
    ids = np.array([*Tokenizer.from_file(tokens.tokenizer_path()).encode(text(2, 80)).ids, 1], "<u4")
    assert one.ids_crc32 == zlib.crc32(ids[: one.length].tobytes()) and one.doc_tokens == len(ids)
    assert packing.pack(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel(n):
    f = token_files.Feistel(n, 99)
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.index(slots) == np.arange(n)).all()


def test_token_files(spark, tmp_path):
    rows = [*ODD, *[(100 + i, text(i, 30)) for i in range(50)]]
    layout, placed = token_files.materialise(table(spark, rows), str(tmp_path / "s"), 1, tokens=32, shard_sequences=16)
    placed = placed.collect()
    back = {r.slot: bytes(r.record) for r in token_files.read_records(spark, layout).collect()}
    assert sorted(back) == list(range(layout.sequences)) == sorted(r.slot for r in placed)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    for r in placed:
        assert zlib.crc32(back[r.slot]) == r.crc32 and layout.place(r.slot) == (r.shard, r.offset) and len(back[r.slot]) == layout.stride
    stream = [x for r in sorted(placed, key=lambda r: r["index"]) for x in np.frombuffer(back[r.slot][:-4], "<u2")[: r.n_tokens]]
    assert Counter(stream) == Counter(x for _, s in rows for x in [*t.encode(s or "", add_special_tokens=False).ids, 1])
    empty, none = token_files.materialise(table(spark, []), str(tmp_path / "e"), 1)
    assert empty.sequences == 0 and none.count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([1, 1, 1, 1]), np.array([0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_quality(spark):
    good = [(i, text(i, 60).replace(" ba", ". Ba")) for i in range(300)]
    bad = [(1000 + i, text(i, 60).upper().replace(" ", "!! ")) for i in range(300)]
    docs = table(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 610 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and (r.doc_id is not None) and (r.doc_id >= 1000 or r.doc_id < 300) and r.doc_id not in {x for x, _ in ODD}]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(table(spark, []), labels).count() == 0


def test_toxicity(spark):
    disguise = [lambda w: w, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: " ".join(w), lambda w: w[0] * 3 + w[1:]]
    rows = [(i, text(i, 40) + (f" {disguise[i % 4](('bogwit', 'dripnozzle')[i % 2])} " + text(i + 1, 5) if i % 5 == 0 else "")) for i in range(1, 800)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(i, r) for i, r in got.items() if r.held_out]
    assert np.mean([r.predicted == (i % 5 == 0) for i, r in held]) > 0.95
    odd = toxicity.toxicity(table(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and {r.score for r in odd} == {0.0}


def likeliest(token, model):
    """The best reading of a token by trying all of them."""
    runs, i = [], 0
    while i < len(token):
        j = i + 1
        while j < len(token) and token[j] == token[i]:
            j += 1
        runs.append((token[i], j - i))
        i = j
    best = (-np.inf, "")
    for way in product(*[toxicity._arcs(c, min(n, 3)) for c, n in runs]):
        state, total, text = 0, 0.0, ""
        for cost, letters in way:
            total += cost
            for x, y in letters:
                if y or state % 28:
                    total += model[state * 28 + y]
                    state, text = (state * 28 + y) % 28**3, text + x
        best = max(best, (total + (model[state * 28] if state % 28 else 0.0), text))
    return best


def test_decode_is_exact():
    rng = np.random.default_rng(6)
    model = np.log(rng.dirichlet(np.full(28, 0.3), 28**3).ravel() + 1e-6).tolist()
    for _ in range(60):
        token = "".join(rng.choice(list("aabce013$ .@"), int(rng.integers(1, 8))))
        assert toxicity.decode(token, model) == likeliest(token, model)[1].strip()
    began = time.time()
    long = toxicity.decode("ab3cdefgh" * 600_000, model)
    assert len(long) > 4_000_000 and time.time() - began < 120


def test_mixing(spark):
    a, b = "abcd efgh", "wxyz uvst"
    rows = [(i, " ".join([a if i % 4 else b] * (1 + i % 7))) for i in range(400)] + ODD
    docs = table(spark, rows)
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(10, 200)], "doc_id long, domain string")
    domains, member = mixing.posteriors(docs, labelled)
    rated, report = mixing.fit_rates(common.written(member, "m"), domains, {"a": 0.5, "b": 0.5})
    got = rated.toPandas()
    p, t = np.array(got.p.tolist()), got.tokens.to_numpy()
    assert (got.rate >= 0).all() and report["residual"] <= 1e-4
    assert np.allclose(p.T @ (t * got.rate.to_numpy()), report["target"], rtol=1e-3)
    mixed, _ = mixing.mix(docs, labelled)
    assert mixed.count() == len(rows) and (mixed.toPandas().copies >= 0).all()
    assert mixing.mix(table(spark, []), labelled)[0].count() == 0
    assert {r.rate for r in mixing.mix(docs, labelled.limit(0))[0].collect()} == {1.0}


def unit(rng, n, d=16):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([unit(rng, 300), unit(rng, 1) + 0.05 * rng.normal(size=(150, 16)), np.repeat(unit(rng, 1), 20, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0]), (1005, [None] * 16)]
    v = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, node int")
    s = embedding_dedup.Settings(neighbours=8, largest=16, block=64, chunk=100, recall=1.0)
    got, report = embedding_dedup.near_vectors(v, s=s)
    got = {r.vec_id: r for r in got.collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (y @ y.T) >= 0.9
    label = brute_components(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a > b])
    assert report["recall"] >= 0.98 and len(got) == len(rows)
    assert all(got[i].n_links == near[i].sum() - 1 and got[i].component_id == label[i] for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in rows[len(x) :])
    assert embedding_dedup.embedding_query(v.limit(0)).count() == 0
    low, report = embedding_dedup.near_vectors(v, s=replace(s, rounds=1, most_rounds=1, recall=1.01))  # out of reach: all are searched exactly
    assert report["searched"] > 400 and {r.vec_id: r.n_links for r in low.collect()} == {i: r.n_links for i, r in got.items()}


def test_double_embeddings(spark):
    """Cosines next to the threshold, other lengths, null and repeated ids."""
    angle = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, [1.0, 0.0]), (2, angle(0.9 + 1e-9)), (3, [0.0, 1.0]), (4, [-angle(0.9 - 1e-9)[1], -angle(0.9 - 1e-9)[0]]), (4, [5.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [0.0, -1.0])]
    v = spark.createDataFrame([(i, e, "x", 2) for i, e in rows], "vec_id long, embedding array<double>, vec string, m int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(v)[0].collect())
    assert got == Counter([(1, 2, 1), (2, 2, 1), (7, 2, 1), (3, 0, 3), (4, 0, 4), (4, 1, 4), (6, 1, 4), (8, 0, 8), (None, 0, None)])


def test_lines(spark):
    long = text(9, 60)
    rows = [*ODD, (50, f"{long}\n\nshort\n{text(10, 50)}"), (51, f"head\n{long}x"), (52, f"SHORT \n{text(11, 40)}\nshort"), (53, long)]
    got = line_dedup.line_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "lang", "id", "norm", "th", "n_lines", "n_removed"]
    by = {r.doc_id: r for r in got}
    assert by[50].text == f"{long}\n\nshort\n{text(10, 50)}" and by[51].text == "head" and by[52].text == text(11, 40) and by[53].text == ""
    assert by[1].text is None and by[8].n_removed == 1 and by[7].n_removed == 0
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def slow_repeats(strings, size):
    seen = Counter(s[i : i + size] for s in strings for i in range(len(s) - size + 1))
    out = []
    for s in strings:
        cover = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - size + 1):
            if seen[s[i : i + size]] > 1:
                cover[i : i + size] = True
        out.append(cover)
    return out


def test_column_bwt():
    rng = np.random.default_rng(2)
    for _ in range(25):
        size = int(rng.integers(1, 5))
        strings = [bytes(rng.choice([0, 97, 98, 255], int(rng.integers(0, 24))).astype(np.uint8)) for _ in range(int(rng.integers(1, 8)))]
        seen = Counter(s[i : i + size] for s in strings for i in range(len(s) - size + 1))
        want = [i + size <= len(s) and seen[s[i : i + size]] > 1 for s in strings for i in range(len(s))]
        assert column_bwt.repeated_suffixes(strings, size).tolist() == want


def test_passages(spark, monkeypatch):
    monkeypatch.setattr(passages, "PART", 3)
    shared, rng = text(30, 60), np.random.default_rng(4)
    rows = [*ODD, (20, "a" * 900), (21, "ab" * 300 + "c"), (22, ""), (23, "é" * 150)]
    rows += [(30 + i, text(60 + i, int(rng.integers(1, 50))) + " " + shared[: int(rng.integers(150, 400))] + " " + text(90 + i, 20)) for i in range(14)]
    got = passages.remove_passages(table(spark, rows)).collect()
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), s, c in zip(rows, data, slow_repeats(data, 200), strict=True):
        kept = bytes(np.frombuffer(s, np.uint8)[~c])
        want[(i, len(s), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == want
    assert passages.remove_passages(table(spark, [])).count() == 0


def test_minima_do_not_depend_on_blocks(monkeypatch):
    lines = ["abc", "x" * 5000, "a line of some words, and others " * 40, "né " * 77, "12345678"]
    whole = line_dedup.minima(lines)
    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    assert (whole == line_dedup.minima(lines)).all()
    assert (whole[2:4] == line_dedup.minima(lines[2:4])).all()
    near = line_dedup.bands(line_dedup.minima([lines[2], lines[2].replace("some", "many", 1)]))
    assert (near[0] == near[1]).any()
