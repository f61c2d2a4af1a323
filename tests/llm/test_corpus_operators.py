"""Operators over all rows: top-k, near-duplicates, language model, mixing, pipeline; brute force and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, elias_fano, mixing, ngram_lm, simhash, voronoi_topk
from tessera.llm.common import fold


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def all_pairs(rows, every, k):
    """rows (id, vector): a query meets every other row whose vector is as long as its own."""
    whole = [(i, np.floor(np.array(v, "f4").astype(float) * 1024).astype(int)) for i, v in rows]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % every == 0:
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(whole) if b != a and len(x) == len(y))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


def test_topk_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = {i: rng.normal(size=8).astype("f4").tolist() for i in range(400)}
    for i in range(100, 180):
        data[i] = data[7]  # one vector, many times
    sound = [*data.items(), (7, data[7]), (20, data[30]), (40, data[40]), *[(2000 + i, [float(i), 1.0]) for i in range(0, 60, 5)], (3000, [0.5] * 3), (5000, [1e5] * 8), (5001, [-1e5] * 8)]
    broken = [(900, None), (1000, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (None, data[1]), (1200, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in sound + broken], "vec_id long, embedding array<float>, score string")
    want = all_pairs(sound, 20, 10)
    got = voronoi_topk.top_k(df, id_col="vec_id", vector_col="embedding", every=20, k=10).collect()
    assert sorted(map(tuple, got)) == want
    monkeypatch.setattr(voronoi_topk, "CELL_ROWS", 64)
    monkeypatch.setattr(voronoi_topk, "CELL_QUERIES", 4)
    got = voronoi_topk.top_k(df.repartition(3), id_col="vec_id", vector_col="embedding", every=20, k=10).collect()
    assert sorted(map(tuple, got)) == want
    few = voronoi_topk.top_k(df.filter("vec_id IN (0, 1, 2)"), id_col="vec_id", vector_col="embedding", every=20, k=10)
    assert few.count() == 2
    assert voronoi_topk.top_k(df.limit(0), id_col="vec_id", vector_col="embedding", every=20, k=10).count() == 0


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_close_pairs_are_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for _ in range(3)]]))
    apart = np.bitwise_count(x[:, None] ^ x[None, :])
    for budget in (0, 1, 2, 3):
        got = {(min(p), max(p)) for i, j in simhash.close_pairs(x, x, True, 63, budget) for p in zip(i.tolist(), j.tolist(), strict=True) if p[0] != p[1]}
        assert got == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(apart <= budget)), strict=True) if a < b}


def test_simhash_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)  # so that cells are walked on in Spark
    rng = random.Random(4)
    texts = [words(rng, 200) for _ in range(60)]
    for i in range(40):
        w = texts[i % 20].split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [None, "", "  \n", texts[3], texts[3].upper(), "one", "One", "a b"]
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    prints = [fingerprint(t) for t in texts]
    root = joined(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {r: min(ids[i] for i in range(len(texts)) if root[i] == r and ids[i] is not None) if any(root[i] == r and ids[i] is not None for i in range(len(texts))) else None for r in set(root)}
    got = {r["id"]: (int.from_bytes(r["sketch"], "little"), r["component_id"]) for r in simhash.groups(df, width=3, budget=2).collect()}
    assert got == {ids[i]: (prints[i], least[root[i]]) for i in range(len(texts))}
    assert simhash.groups(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (7, 7), (300, 301), (301, 302), (302, 300)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 301: 300, 302: 300}


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (1000, 10**12), (1000, 1200), (3, 2**63)):
        v = np.unique(rng.integers(0, u, n, dtype=np.uint64))
        elias_fano.save(f"{tmp_path}/{n}-{u}", elias_fano.EliasFano.encode(v, u))
        seq = elias_fano.EliasFano(elias_fano.load(f"file://{tmp_path}/{n}-{u}"))
        assert (seq.access(np.arange(len(v))) == v).all()
        place = {x: i for i, x in enumerate(v.tolist())}
        asked = np.concatenate([v, rng.integers(0, u, 300, dtype=np.uint64)])
        assert seq.search(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]


def test_language_model(spark):
    rng = random.Random(8)
    texts = {i: words(rng, rng.randrange(0, 60), 25) for i in range(80)} | {80: None, 81: "", 82: "never seen words", 83: "w1 w2 w3 " * 50}
    df = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "doc_id long, text string, score double")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    model = ngram_lm.train(df.filter(~(fold(F.col("doc_id"), 7) == 2)))
    got = {r["doc_id"]: r for r in ngram_lm.score(df.drop("score"), model, keep=["doc_id"]).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            c1.update(t)
            c2.update(zip([b"", *t], t, strict=False))
            c3.update(zip([b"", *t], t, t[1:], strict=False))
    n, v, d = sum(c1.values()), len(c1), ngram_lm.DISCOUNT
    k2, k3 = ({k: x for k, x in c.items() if x >= 2} for c in (c2, c3))
    g2, g3 = Counter(), Counter()
    for (h, _), x in k2.items():
        g2[h] += x - d
    for (a, h, _), x in k3.items():
        g3[a, h] += x - d

    def p2(h, w):
        p1 = (c1[w] + 1) / (n + v + 1)
        return p1 if h not in c1 else max(k2.get((h, w), d) - d, 0) / c1[h] + (1 - g2[h] / c1[h]) * p1

    def p3(a, h, w):
        return p2(h, w) if (a, h) not in k2 else max(k3.get((a, h, w), d) - d, 0) / k2[a, h] + max(1 - g3[a, h] / k2[a, h], 1e-12) * p2(h, w)

    assert len(got) == len(texts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c1[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        want = math.log10(p2(b"", t[0])) + sum(math.log10(p3(*x)) for x in zip([b"", *t], t, t[1:], strict=False))
        assert math.isclose(r["score"], want, rel_tol=0.05, abs_tol=0.2), i
    empty = ngram_lm.train(df.limit(0))
    assert ngram_lm.score(df.limit(3), empty, keep=["doc_id"]).filter("base_score = 0 AND n_known = 0").count() == 3
    assert ngram_lm.score(df.limit(0), model, keep=["doc_id"]).count() == 0


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 80)), ["a", "b", "b", "b", "b", "c", None][i % 7], i, 1) for i in range(700)]
    rows += [(700, None, "a", 1, 1), (701, "", "empty", 1, 1), (5, rows[5][1], rows[5][2], 5, 1), (None, "one two", "b", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:  # share, stop, share again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    target |= share
    taken = defaultdict(int)
    for r in out:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 80 for s in order)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_passes_over_what_does_not_fit(spark):
    # source b has a target of about 9,000 words, 10,000 in short documents, and one of 20,000
    rows = [(i, "w " * 100, "a") for i in range(240)] + [(1000 + i, "w " * (90 + i % 20), "b") for i in range(100)] + [(2000, "w " * 20_000, "b")]
    for seed in range(4):
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(5, 1), seed=seed).collect()
        for source in "ab":
            own = [r for r in out if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60, (seed, source)


def test_mixing_is_the_walk_in_order(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 3, 10, 50, 400, 2000]), rng.choice(["a", "b", None])) for i in range(400)]
    out = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for source in ("a", "b", None):
        own = [r for r in out.values() if r["source"] == source]
        whole, ratio = math.floor(own[0]["target"] / own[0]["source_size"]), own[0]["target"] / own[0]["source_size"]
        p, gap = ratio - whole, own[0]["target"] - whole * own[0]["source_size"]
        texts = {i: t for i, t, _ in rows}
        u = {r["doc_id"]: (int(hashlib.md5(f"20|{r['doc_id']}|{texts[r['doc_id']]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for r in own}
        order = sorted(own, key=lambda r: u[r["doc_id"]])
        taken = set()
        for r in order if p else []:
            if r["size"] <= gap and gap > mixing.NEAR * own[0]["target"]:
                gap -= r["size"]
                taken.add(r["doc_id"])
        rest = [(abs(r["size"] - gap), k) for k, r in enumerate(order) if r["doc_id"] not in taken and abs(r["size"] - gap) < gap]
        if p and rest:
            taken.add(order[min(rest)[1]]["doc_id"])
        assert {r["doc_id"] for r in own if r["copies"] > whole} == taken


def test_pipeline(spark):
    rng = random.Random(6)
    english, german = "the cat sat on that mat with hats and other things they have".split(), "zum hund über grün mögen wüst böse straße schön das und".split()
    rows = [(i, " ".join(rng.choice(english if i % 2 else german) + str(rng.choice(["", "s", "en"])) for _ in range(120)), ["en", "de"][i % 2 == 0], f"s{i % 3}", 0) for i in range(90)]
    near = rows[4][1].split()
    near[60] = "changed"
    clash = ["copies", "lang_pred", "other_share", "size", "copy", "score"]
    rows += [(200, rows[3][1], "en", "s0", 0), (201, " ".join(near), "de", "s1", 0), (202, None, None, None, 0), (203, "12 34", None, "s1", 0), (None, rows[9][1], None, "s2", 0), rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("kept") for c in clash})
    found = dict(corpus_pipeline.STAGES)
    told = found["language identification"](spark, df, "")
    assert told.columns == df.columns and {r["doc_id"] for r in told.collect()} == {r[0] for r in rows} - {202, 203}
    single = found["near-deduplication"](spark, told, "")
    assert sorted(r["doc_id"] for r in single.collect()) == list(range(90))
    mixed = found["mixing"](spark, single, "")
    assert mixed.columns == df.columns and {r["doc_id"] for r in mixed.collect()} <= set(range(90))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})
    assert all(mixed.filter(F.col(c) != "kept").count() == 0 for c in clash)
    tokens = found["byte-level tokens"](spark, mixed, "")
    assert tokens.filter("NOT restored").count() == 0 and tokens.count() == mixed.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0


def brute_top_k(rows, every, k):
    """rows (id, doubles) to the k best integer inner products of each query, clamped to 64 bits."""
    whole = [(i, [int(Fraction(x) * 1024 // 1) for x in v]) for i, v in rows]
    out = []
    for n, (i, a) in enumerate(whole):
        if i % every == 0:
            found = [(min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), j) for m, (j, b) in enumerate(whole) if m != n and len(a) == len(b)]
            out += [(i, at + 1, j, s) for at, (s, j) in enumerate(sorted(found, key=lambda f: (-f[0], f[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 4e5, 1e9, 2.0**52, 3e17, 1e300])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (size if i % 3 == 0 else 1.0)]) for i in range(40)]
    rows += [(100, [size, 0.0, 0.0, 0.0, 0.0, 0.0]), (101, [-size, 0.0, 0.0, 0.0, 0.0, 0.0]), (102, [0.0] * 6), (103, [1.5] * 6), (105, [size])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = voronoi_topk.top_k(df, id_col="vec_id", vector_col="embedding", every=5, k=7).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 5, 7)


def test_scores_at_the_ends_of_the_range():
    a = np.array([[2**31, 2**31], [2**61, 1], [-(2**61), 0]], np.int64)
    b = np.array([[2**31, 2**31 - 1], [4, -1], [3, 3], [-4, 0], [2**61, 2**61]], np.int64)
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(r, c)), -(2**63)), 2**63 - 1) for c in b] for r in a]
    assert voronoi_topk._exact(a, b).tolist() == want
