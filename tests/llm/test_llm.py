"""The training-data operators against brute force, libraries and round trips, on small awkward tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex  # noqa: F401
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from marginforge.llm import bpe, chat, features, hnsw, jaccard, mixing, quality, queries, sharding, topk, toxicity, urls

P = pytest.importorskip("public_tokenizers")
WORDS = "the of and to in that was his with for on are be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Rows (doc_id, text, source) with extra, clashing columns."""
    full = [(i, t, "en", s, None if t is None else len(t), *CLASH) for i, t, s in rows]
    names = ("size string, score double, Predicted string, taken string, copies int, target binary, source_size string, _of int, h string, n int, row string, v string, `a.b` int, decoded string, token_ids string")
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + names)


CLASH = ("x", 0.125, "p", "t", -5, bytearray(b"t"), "many", 7, "head", -1, "r", "vv", 9, "d", "i")


def unchanged(rows, columns):
    """Every clashing column still holds what came in."""
    return all(tuple(r)[-len(CLASH) :] == CLASH for r in rows) and len(columns) == 5 + len(CLASH)


def awkward(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randint(1, 80)), f"s{i % 3}") for i in range(n)]
    rows += [(n + k, rows[0][1], "s0") for k in range(15)]
    rows += [(900, None, None), (901, "", "s1"), (902, "   \t", "s2"), (903, text(rng, 5000), "s0"), (None, "no id here at all", "s1"), (5, rows[5][1], "s2")]
    return rows


# -- 1 ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    raw = bpe.load_ranks(path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.codec(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), path


def test_bpe_equals_library(tokenizer):
    own, other, _ = tokenizer
    rng = random.Random(0)
    cases = ["", " ", "a", "\n\n  x", "don't  stop", "naïve Ünïcode 漢字 🙂🙂", "x" * 5000, "ab" * 400, "ß" * 300, "<|endoftext|>", "\x1c\x85  a"]
    cases += ["".join(rng.choice("abcdeftion ěž'.\n09") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    for t, ids in zip(cases, own.encode(cases)):
        assert ids == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    piece = b"thththionionqu" * 12
    assert own._heap(piece) == own._matrix([piece])[0]


def test_bpe_frames(spark, tokenizer):
    own, other, path = tokenizer
    df = documents(spark, awkward())
    got = bpe.round_trip(df, path, P.PATTERN).collect()
    assert len(got) == len(awkward())
    for r in got:
        ids = other.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------
def shards_of(spark, rows, n):
    got = sharding.kd_shards(documents(spark, rows), n).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    return got


def test_sharding_balances_bytes(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, rng.randint(5, 30)), f"s{i % 5}") for i in range(400)] + [(1000 + k, "the same text in a third of rows " * 3, "s0") for k in range(200)]
    got = shards_of(spark, rows, 7)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert set(size) == set(range(7)) and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert all((r.size, r.text_crc32) == want[r.doc_id] for r in got)


def test_sharding_cuts_equal_weighted_medians(spark, monkeypatch):
    """One level against rows sorted by hand: the left half ends at the row nearest half the bytes."""
    rng = random.Random(6)
    rows = [(i, text(rng, rng.randint(1, 60)), "s") for i in range(300)] + [(500 + k, "copies " * 9, "s") for k in range(150)]
    for sorted_rows, bins in ((100_000, 4096), (5, 8)):  # by one sort, and through many rounds of bins
        monkeypatch.setattr(sharding, "SORTED_ROWS", sorted_rows)
        monkeypatch.setattr(sharding, "BINS", bins)
        got = sharding.kd_shards(documents(spark, rows), 2).collect()
        left, total = sum(r.size for r in got if r.shard == 0), sum(r.size for r in got)
        assert abs(2 * left - total) <= max(r.size for r in got)
    many = sharding.kd_shards(documents(spark, rows), 40).collect()
    size = Counter()
    for r in many:
        size[r.shard] += r.size
    assert len(size) == 40 and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in many)


def test_sharding_awkward(spark):
    shards_of(spark, awkward(), 5)
    shards_of(spark, [(1, "a", "s")] * 3, 4)
    assert sharding.kd_shards(documents(spark, awkward()).limit(0), 3).count() == 0


# -- 3, 5 ------------------------------------------------------------------------------------------
def vectors(seed=0, n=700, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(6, size=n)] * 0.3 + rng.normal(size=(n, d)) * 0.2).astype(np.float32)
    x[n // 3 : n // 3 + 150] = x[0]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(9001, None), (9002, []), (9003, [float("nan")] * d), (9004, [None] + [1.0] * (d - 1)), (9005, [0.0] * d), (9010, [float("inf")] * d), (9020, [1.0, 2.0]), (None, x[1].tolist()), (20, x[20].tolist())]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "r") for i, v in rows], "vec_id long, embedding array<double>, v string, row string")


def usable(rows):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]


def by_query(df):
    """Sorted results of each query id; queries that share an id lie side by side."""
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_hnsw_recall(spark):
    rows = vectors()
    good = [(i, v) for i, v in usable(rows) if np.any(v)]
    got = by_query(hnsw.nearest(frame(spark, rows), every=10, k=5, shard_rows=200))
    assert set(got) == {i for i, v in good if i % 10 == 0 and len(v) == 12}
    hit = total = 0
    for q, found in got.items():
        own = [n for n, (i, _) in enumerate(good) if i == q]
        assert [f[0] for f in found] == sorted([1, 2, 3, 4, 5] * len(own))
        best = []
        for n in own:
            cos = [(float(v @ good[n][1] / np.linalg.norm(v) / np.linalg.norm(good[n][1])), i) for k, (i, v) in enumerate(good) if k != n and len(v) == 12]
            best += [i for _, i in sorted((-round(c, 12), i) for c, i in cos)[:5]]
            assert all(any(abs(c - s) < 1e-12 and i == x for c, x in cos) for _, i, s in found)
        hit, total = hit + sum((Counter(best) & Counter(i for _, i, _ in found)).values()), total + len(best)
    assert len(got[20]) == 10  # two rows of one id, each the other's nearest
    assert sum(1 for r, i, _ in got[20] if r == 1 and i == 20) == 2
    assert hit / total >= 0.95
    assert hnsw.nearest(frame(spark, rows).limit(0), 10, 5).count() == 0


def test_hnsw_tiny_and_huge_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    size = rng.choice([1e-200, 1e200, 1.0], 60)
    got = by_query(hnsw.nearest(frame(spark, [(i, (v * f).tolist()) for i, (v, f) in enumerate(zip(x, size))]), every=20, k=5))
    for q, found in got.items():
        cos = {i: float(x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q])) for i in range(60) if i != q}
        assert [i for _, i, _ in found] == sorted(cos, key=lambda i: -cos[i])[:5] and all(abs(cos[i] - s) < 1e-12 for _, i, s in found)


def brute_top(rows, every, k):
    good = [(i, [int(v) for v in np.floor(64 * x)]) for i, x in usable(rows)]
    out = {}
    for n, (q, x) in enumerate(good):
        if q % every == 0:
            dots = [(-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(good) if m != n and len(y) == len(x)]
            best = sorted(dots)[:k]
            if best:
                out.setdefault(q, []).extend((r + 1, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for r, (s, i) in enumerate(best))
    return {q: sorted(x) for q, x in out.items()}


def test_topk_is_exact(spark):
    rows = vectors(1)
    assert by_query(topk.largest(frame(spark, rows), every=20, k=20, shard_rows=150)) == brute_top(rows, 20, 20)
    assert topk.largest(frame(spark, rows).limit(0), 20, 20).count() == 0


def test_topk_keeps_large_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 5)) * 2.0 ** rng.choice([0, 0, 0, 12, 22, 30, 60, 100, 500], (240, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, [300000.0, 1.0, 0.0, 0.0, 0.0]), (420, [1e308] * 5), (440, [2e306] * 5), (441, [-2e306] * 5), (442, [2.0**52 + 1, 0.5, 0.0, 0.0, 0.0])]
    want = brute_top([r for r in rows if r[0] != 420], 20, 20)  # 64 times 1e308 is not finite
    assert by_query(topk.largest(frame(spark, rows), every=20, k=20, shard_rows=60)) == want


def test_topk_query_chunks(spark, monkeypatch):
    from marginforge.llm import vectors as shared

    monkeypatch.setattr(shared, "QUERY_BYTES", 1000)
    rows = vectors(2, 300)
    assert by_query(topk.largest(frame(spark, rows), every=20, k=20, shard_rows=150)) == brute_top(rows, 20, 20)


# -- 4, 6 ------------------------------------------------------------------------------------------
def labelled(spark, kind):
    rng, docs, labels = random.Random(7), [], []
    for i in range(600):
        t, bad = text(rng, rng.randint(20, 120)), i % 4 == 0
        if bad:
            w = t.split()
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["wretch", "fiend", "knave"]) if kind == "toxic" else "###"
            t = " ".join(w)
        docs.append((i, t, "s"))
        if i % 3:
            labels.append((i, int(not bad), int(bad)))
    return documents(spark, docs + [(900, None, "s"), (901, "", "s"), (902, text(rng, 20000), "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_holds_out(spark):
    docs, labels = labelled(spark, "quality")
    w = quality.fit(docs, labels, "quality", F.col("doc_id") % 5 != 2)
    names = ("s", "p")
    got = {r.doc_id: Row(doc_id=r.doc_id, score=r.s, predicted=r.p) for r in quality.score(docs, w, names=names).collect()}
    with pytest.raises(ValueError):
        quality.score(docs, w)
    kept = quality.kept(docs, lambda d, names: quality.score(d, w, names=names), lambda s: s >= 0.5)
    assert kept.columns == docs.columns and unchanged(kept.collect(), kept.columns)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.5}
    docs = docs.select("doc_id", "text")
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in range(600) if i % 5 == 2]
    assert np.mean([(got[i].score >= 0.5) == (i % 4 != 0) for i in held]) > 0.95
    none = quality.fit(docs, labels.limit(0), "quality", F.lit(True))
    assert quality.score(docs.limit(3), none).head().score == 0.5
    assert quality.score(docs.limit(0), w).count() == 0
    assert (quality.fit(docs, labels, "quality", F.col("doc_id") % 5 != 2) == w).all()


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels = labelled(spark, "toxic")
    docs = docs.select("doc_id", "text")
    w = toxicity.fit(docs, labels, "toxic", F.col("doc_id") % 5 != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, w).collect()}
    held = [i for i in range(600) if i % 5 == 2]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0
    none = toxicity.fit(docs, labels.limit(0), "toxic", F.lit(True))
    assert toxicity.score(docs.limit(3), none).head().predicted == 0


def test_ftrl_is_close_to_batch():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(2000, 5))
    y = (X @ [2, -1, 0, 0.5, 0] > rng.logistic(size=2000)).astype(float)
    m = quality.Ftrl(5, l1=0.0, l2=0.0)
    for _ in range(5):
        for r, v in zip(X, y):
            m.update(np.arange(5), r, v)
    assert np.abs(m.weights() - [2, -1, 0, 0.5, 0]).max() < 0.4


def test_samples_bound_rows(spark):
    rows = [(k % 3, f"text {k}", "s") for k in range(90)]
    labels = spark.createDataFrame([(k % 3, 1, 1) for k in range(30)], "doc_id long, quality int, toxic int")
    got = quality.training_sample(documents(spark, rows), labels, "quality", F.lit(True), 2).collect()
    assert len(got) == 2 and all(r.text == min(t for i, t, _ in rows if i == r.doc_id) for r in got)
    picked = labels.select("doc_id").distinct().withColumn("p", F.lit(1))
    assert quality.one_text(documents(spark, rows), picked).count() == 3


def test_ftrl_update_by_hand():
    """Two steps of the published update on a dense pair of coordinates, written out."""
    a, b, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n, m = [0.0, 0.0], [0.0, 0.0], quality.Ftrl(2, a, b, l1, l2)
    for x, y in (((1.0, -0.5), 1.0), ((0.3, 2.0), 0.0)):
        w = [0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((b + n[i] ** 0.5) / a + l2) for i in (0, 1)]
        p = 1 / (1 + np.exp(-(w[0] * x[0] + w[1] * x[1])))
        for i in (0, 1):
            g = (p - y) * x[i]
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
        m.update(np.arange(2), np.array(x), y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_nnpu_lowers_the_corrected_risk():
    """The risk computed directly: below that of any constant score and of nearby weights."""
    rng = np.random.default_rng(3)
    size, prior = 40, 0.3
    draw = lambda n, p: [np.flatnonzero(rng.random(size) < p) for _ in range(n)]
    toxic, clean = np.where(np.arange(size) < 6, 0.5, 0.2), np.where(np.arange(size) < 6, 0.02, 0.2)
    pos = draw(300, toxic)
    unl = draw(300, toxic) + draw(700, clean)
    w = toxicity.nnpu(pos, unl, size, prior)

    def risk(w):
        f = lambda rows: np.array([w[r].sum() + w[-1] for r in rows])
        fp, fu = f(pos), f(unl)
        return prior * np.logaddexp(0, -fp).mean() + max(0.0, np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())

    flat = min(risk(np.append(np.zeros(size), c)) for c in np.linspace(-4, 4, 81))
    assert risk(w) < 0.8 * flat
    assert all(risk(np.append(w[:-1], w[-1] + c)) > 0.9 * risk(w) for c in (-1, -0.5, 0.5, 1))
    truth = np.array([1] * 300 + [0] * 700)
    f = np.array([w[r].sum() + w[-1] for r in unl])
    assert ((f > 0) == truth).mean() > 0.9


def test_features_fold_case_and_mark():
    h = features.Hasher(18)
    a, b = h("Same words here"), h("same Words HERE")
    assert set(a[0]) <= set(b[0]) and len(b[0]) == len(a[0]) + 1
    assert len(h("")[0]) == len(h(None)[0]) == 0


# -- 7 ---------------------------------------------------------------------------------------------
def test_mixing_targets(spark):
    rows = awkward()
    plain = lambda d: d.select("doc_id", "text", "source")
    got = mixing.plan_copies(plain(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    total, target = sum(r.size for r in got), {r.source: (r.source_size, r.target) for r in got}
    weight = dict(zip(sorted([s for s in target if s is not None]) + [None], [1, 2, 3, 1]))
    cap, left = {}, set(target)
    while True:  # reshare until none is above
        room, over = total - sum(cap.values()), set()
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * target[s][0]}
        if not over:
            break
        cap |= {s: 3 * target[s][0] for s in over}
        left -= over
    want = cap | share
    assert all(abs(target[s][1] - want[s]) < 1e-6 for s in target)
    assert all(r.taken in {r.size * int(r.target / max(r.source_size, 1)), r.size * (int(r.target / max(r.source_size, 1)) + 1)} and r.taken <= 3 * r.size for r in got)
    mixed = mixing.emit(documents(spark, rows))
    assert mixed.count() == sum(r.copies for r in got) and unchanged(mixed.collect(), mixed.columns)
    with pytest.raises(ValueError):
        mixing.plan_copies(documents(spark, rows))
    again = mixing.plan_copies(plain(documents(spark, rows[::-1])).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_comes_near(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, 10), f"s{i % 4}") for i in range(4000)]
    plain = documents(spark, rows).select("doc_id", "text", "source")
    per = mixing.plan_copies(plain).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.1 for r in per)
    assert mixing.plan_copies(plain.limit(0)).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------
def brute_join(rows, n, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_equals_brute_force(spark, n, percent):
    rng = random.Random(11)
    rows = awkward(2, 40)
    for base in range(6):  # chains of near copies: neighbours link, ends may not
        w = text(rng, rng.choice([12, 25, 60, 150])).split()
        for k in range(12):
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(9))
            rows.append((2000 + base * 50 + k, " ".join(w), "s1"))
    common = text(rng, 30)  # one passage in many otherwise different short texts
    rows += [(3000 + k, common + " " + " ".join(f"w{k}x{j}" for j in range(6)), "s2") for k in range(40)]
    got = jaccard.join_documents(documents(spark, rows), n, percent).collect()
    want = brute_join(rows, n, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_jaccard_crowds_equal_brute_force(spark, monkeypatch):
    """Large runs whose heads link with few: by blocks of sketches, several a run."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    rng = random.Random(5)
    rows, base = [(7000, "one two three", "s")], [f"w{k}" for k in range(240)]
    for k in range(60):  # about as far from each other as linked texts may be
        w = list(base)
        for j in rng.sample(range(240), 4 if k % 3 else 5):
            w[j] = f"x{rng.randrange(10**6)}"
        rows.append((k * 7 % 60, " ".join(w), "s"))
    got = jaccard.join_documents(documents(spark, rows), 3, 90).collect()
    want = brute_join(rows, 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 5 < len({c for _, c in want.values()})


def test_crowded_pairs_grow_with_the_runs(spark, monkeypatch):
    """Groups just under the threshold, no link at all: pairs that leave the blocks do not grow with the square."""
    sent, real = [], jaccard.likely

    def likely(pairs, known, percent):
        sent.append(pairs.count())
        return real(pairs, known, percent)

    monkeypatch.setattr(jaccard, "likely", likely)
    monkeypatch.setattr(jaccard, "FEW", 8)
    total = []
    for n in (100, 200):
        rng, rows, base = random.Random(n), [], [f"w{k}" for k in range(600)]
        for k in range(n):
            w = list(base)
            for j in rng.sample(range(600), 6):
                w[j] = f"x{k}y{j}"
            rows.append((k, " ".join(w), "s"))
        sent.clear()
        got = jaccard.join_documents(documents(spark, rows), 3, 90)
        assert got.select("component_id").distinct().count() == len({c for _, c in brute_join(rows, 3, 90).values()})
        total.append(sum(sent))
    assert 0 < total[1] < 3.2 * total[0]


def test_known_sketches_settle_crowds_of_unlike_texts(spark, monkeypatch):
    """Members of a run that are far from each other need no long sketches of their texts."""
    read = []
    real = jaccard._by_texts
    monkeypatch.setattr(jaccard, "_by_texts", lambda *a: read.append(1) or real(*a))
    monkeypatch.setattr(jaccard, "FEW", 8)
    rows = [(k, " ".join(["w1", "w2", "w3"] + [f"x{k}y{j}" for j in range(17)]), "s") for k in range(60)]
    got = jaccard.join_documents(documents(spark, rows), 1, 60).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k in range(60)} and not read


def test_runs_of_two_hold_no_other_pair(spark):
    """A head with many partners of different runs is no crowd: their marks are empty, so they meet nobody else."""
    near = lambda k: " ".join([f"w{j}" for j in range(400)] + [f"x{k}"])
    two, three = documents(spark, [(k, near(k), "s") for k in (1, 2)]), documents(spark, [(k, near(k), "s") for k in (1, 2, 3)])
    runs = lambda d: {(r.h, r.x): r.ma.bit_count() for r in jaccard.candidates(d, 1, 90).collect()}
    assert runs(two)[1, 2] <= 4  # of a task's last run it is not known whether it goes on
    assert runs(three)[1, 2] > 8 and runs(three)[1, 3] > 8


def test_one_row_a_class_has_signatures(spark, monkeypatch):
    given, real = [], jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda docs, words, percent: given.append([r.doc_id for r in docs.collect()]) or real(docs, words, percent))
    rows = [(k, "a b c d" if k % 2 else "e f g h", "s") for k in range(10)] + [(3, "i j k l", "s"), (None, "a b c d", "s")]
    for most in (jaccard.BROADCAST_IDS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", most)
        got = jaccard.join_documents(documents(spark, rows), 3, 90).collect()
        assert {(r.doc_id, r.component_id) for r in got} >= {(k, k % 2) for k in range(10)} | {(3, 3)}
    assert all(set(g) == {0, 1, 3} for g in given) and len(given) == 2


def test_jaccard_empty_and_keep_one(spark):
    rows = awkward()
    assert jaccard.join_documents(documents(spark, rows).limit(0), 3, 90).count() == 0
    kept = jaccard.keep_one(documents(spark, rows), words=3, percent=90)
    want = brute_join(rows, 3, 90)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 1
    assert kept.columns == documents(spark, rows).columns and unchanged(kept.collect(), kept.columns)


def test_signatures_meet():
    """Any two linked sets share a signature, one of them undeleted."""
    rng = np.random.default_rng(0)
    for percent in (90, 80, 60):
        bands = jaccard.Bands(percent)
        for _ in range(150):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            drop = int(rng.integers(0, bands.bound(n, n) // 2 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, drop).astype(np.uint64)]))
            c = len(np.intersect1d(a, b))
            if 100 * c < percent * (len(a) + len(b) - c) or np.array_equal(a, b):
                continue
            (sa, fa), (sb, fb) = bands.signatures(a), bands.signatures(b)
            x, y = dict(zip(sa.tolist(), fa.tolist())), dict(zip(sb.tolist(), fb.tolist()))
            ok = any((x[s] < 2 or y[s] < 2) and (x[s] % 2 == 0 or y[s] % 2 == 0) for s in x.keys() & y.keys())
            assert ok


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 40, 700, 9000):
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        for drop, add in ((0, 0), (n // 10, n // 20), (n // 3, 4 * n)):
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, add).astype(np.uint64)]))
            u, v = jaccard.sketch(a), jaccard.sketch(b)
            w = min(len(u), len(v))
            apart = int(np.bitwise_count((jaccard.fold(u, w) ^ jaccard.fold(v, w)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b)) and (apart == 0 or drop or add)


# -- 9 ---------------------------------------------------------------------------------------------
TALK = [
    (1, 1, "assistant", "Yes </s>[INST] \\[INST]"), (1, 0, "user", "plain"), (1, 2, "user", None), (2, 0, "system", "be <<SYS>> kind\\"), (2, 1, "tool [/ROLE]\n", "out\n\n</s>"),
    (2, 2, None, "who"), (3, 0, "assistant", ""), (3, 0, "assistant", "漢字"), (None, 0, "user", "lost"), (4, 0, "user", "</s>"), (4, 1, "assistant", "x" * 50000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "c") for r in TALK], "conv_id long, turn long, role string, text string, formatted string")
    parts = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    raw = {}
    for r in parts.collect():
        raw[r.conv_id] = raw.get(r.conv_id, "") + bytes(r.formatted).decode()
    for conv in got:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in TALK if c == conv))
        assert chat.parse(raw[conv]) == [(r, x) for _, r, x in turns]
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[conv].loss_chars == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv].formatted_chars == len(raw[conv]) and got[conv].n_turns == len(turns)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_conversation_over_many_batches(spark):
    df = spark.range(25_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.read_back(chat.format_chats(df)).collect()
    assert len(r) == 1 and r[0].n_turns == 25_000
    assert r[0].loss_sha256 == hashlib.sha256("".join(str(i) for i in range(1, 25_000, 2)).encode()).hexdigest()


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(["\\", "<s>", "</s>", "[INST]", "a", "<", "[", "/", ">", "]", "<<SYS>>"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and not any(t2 for t2 in regex.findall(r"(?<!\\)(?:<s>|</s>|\[INST\]|<<SYS>>)", chat.escape(t)))


# -- 10 --------------------------------------------------------------------------------------------
def test_url_rules_and_graph(spark):
    link = lambda *h: "".join(f'<a href="https://{x}/p">x</a>' for x in h)
    pages = [
        (1, "https://Good.example.com/en/77?x#y", link("friend.org")), (2, "http://bad.net/de/1", link("hub.org")), (3, "https://friend.org/a", link("good.example.com")),
        (4, "https://linker.org/a", link("bad.net") + "<a href='/own'>"), (5, None, None), (6, "no scheme", "x"), (7, "https://example.net/de/8", None), (8, "https://com/en/", ""),
        (9, "https://x.com/en", None), (10, "https://lonely.org?q", "<a href=//bad.net/x>"), (None, "https://notcom/en/1", None), (9, "https://x.com/en", None),
    ]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(df, queries.URL_RULES).collect()}
    assert got[1, "good.example.com", "/en/77"] == ("example.com/en/7", "allow")
    assert got[2, "bad.net", "/de/1"] == ("net/de/", "block")
    assert got[3, "friend.org", "/a"] == (None, "allow")
    assert got[4, "linker.org", "/a"] == (None, "block")  # links to the blocked
    assert got[10, "lonely.org", ""] == (None, "block")
    assert got[5, "", ""] == got[6, "", ""] == (None, "allow")
    assert got[7, "example.net", "/de/8"] == ("example.net/de/8", "allow")
    assert got[8, "com", "/en/"] == ("com/en/", "block") and got[9, "x.com", "/en"][0] is None and got[None, "notcom", "/en/1"][0] is None
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_pagerank_against_numpy(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): int(n) for a, b, n in rng.integers(1, 9, (25, 3))}
    edges |= {(20 + k, 21 + k): 1 for k in range(30)} | {(1, 20): 2}  # a path longer than a dozen links
    df = spark.createDataFrame([("t", str(a), str(b), n) for (a, b), n in edges.items()], "walk string, src string, dst string, n long")
    seeds = spark.createDataFrame([("t", "1", 3.0), ("t", "2", 1.0)], "walk string, host string, weight double")
    got = {r.host: r.mass for r in urls.pagerank(df, seeds, tolerance=1e-6).collect()}
    M = np.zeros((52, 52))
    for (a, b), n in edges.items():
        M[b, a] = n
    M = M / np.maximum(M.sum(0), 1)
    s = np.zeros(52)
    s[1], s[2] = 0.75, 0.25
    r = np.linalg.solve(np.eye(52) - 0.85 * M, 0.15 * s)
    assert sum(abs(got.get(str(k), 0) - r[k]) for k in range(52)) < 1e-6 and got["45"] > 0
    empty = {r.host: r.mass for r in urls.pagerank(df.limit(0), seeds).collect()}
    assert abs(empty["1"] - 0.75 * 0.15) < 1e-12


def brute_urls(pages, rules, threshold=0.1):
    """The whole query by hand: links, both walks solved exactly, thresholds."""

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    judged = [(i, *parts(u), *rule(*parts(u)), html or "") for i, u, html in pages]
    links, seeds = Counter(), {"allow": Counter(), "block": Counter()}
    for _, host, _, _, v, html in judged:
        for m in re.finditer(r"""(?:href|src)\s*=\s*["']?((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"'\s>]+)""", html):
            to = parts("http:" + m[1] if m[1].startswith("//") else m[1])[0]
            if host and to:
                links[host, to] += 1
        if host and v:
            seeds[v][host] += 1
    names = sorted({h for e in links for h in e} | set(seeds["allow"]) | set(seeds["block"]))
    at, mass = {h: k for k, h in enumerate(names)}, {}
    for w in seeds:
        M = np.zeros((len(names), len(names)))
        for (a, b), n in links.items():
            a, b = (a, b) if w == "allow" else (b, a)
            M[at[b], at[a]] += n
        M = M / np.maximum(M.sum(0), 1e-300) if len(names) else M
        s = np.array([seeds[w][h] for h in names], float)
        mass[w] = np.linalg.solve(np.eye(len(names)) - 0.85 * M, 0.15 * s / max(s.sum(), 1))
    reached = [k for k in range(len(names)) if mass["allow"][k] > 0 or mass["block"][k] > 0]
    block = {names[k] for k in reached if mass["block"][k] - mass["allow"][k] > threshold / len(reached)}
    return sorted((str(i), h, p, str(r), v or ("block" if h in block else "allow")) for i, h, p, r, v, _ in judged)


def test_url_query_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"{a}.example.{t}" for a in ("aa", "bb", "cc", "dd", "m.ee", "ff") for t in ("com", "net", "org")] + ["Lone.info", "end.info"]
    pages = [(k, None if k == 7 else f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(90)}{rng.choice(['', '?q=1', '#x'])}", "".join(f'<a href="//{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4)))) for k in range(150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in urls.judge(df, queries.URL_RULES, tolerance=1e-9).collect())
    assert got == brute_urls(pages, queries.URL_RULES)
    assert {v for *_, r, v in got if r == "None"} == {"allow", "block"}


def test_url_query_rules_are_the_contracts(spark, tmp_path):
    """Each rule's word as the contract lists it, through the registered query; nothing here is read off its rules."""
    said = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"),
        "http://a.net/de/8": ("net/de/", "allow"), "http://b.example.net/de/7": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(said)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(said.values()))


# -- queries and pipeline ---------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, same, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


CONTRACT = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_kd_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_hnsw": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_quality_ftrl": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_toxicity_nnpu": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_query(spark, sf, name, tokenizer):
    """Every contract query over its whole table: columns, row counts, and values by hand where SQL does not say them."""
    df = queries.QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == CONTRACT[name]
    rows = df.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    if name in ("op1_byte_bpe", "op2_kd_sharding", "op4_quality_ftrl", "op6_toxicity_nnpu", "op8_jaccard_join"):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name == "op1_byte_bpe":
        for r in rows:
            ids = tokenizer[1].encode_ordinary(docs[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    if name == "op2_kd_sharding":
        per = {}
        for r in rows:
            raw = docs[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            per.setdefault(r.shard, []).append(r.slot)
        assert set(per) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in per.values())
    if name in ("op4_quality_ftrl", "op6_toxicity_nnpu"):
        mod, rest = (4, 2) if name[2] == "4" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op8_jaccard_join":
        want = brute_join([(i, t, None) for i, t in docs.items()], 3, 90)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    if name == "op3_hnsw":
        x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
        hit = 0
        for q in {r.query_id for r in rows}:
            cos = sorted((-float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q])), i) for i, v in x.items() if i != q)[:5]
            hit += len({i for _, i in cos} & {r.vec_id for r in rows if r.query_id == q})
        assert hit >= 0.95 * len(rows) and len(rows) == 5 * sum(i % 50 == 0 for i in x)
    if name == "op10_url_filter":
        pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in rows) == brute_urls(pages, queries.URL_RULES)


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Every stage on nulls, repeated ids, clashing columns and no rows: columns and values come back unchanged."""
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and unchanged(rows, out.columns), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.encoding_stage(spark, docs.drop("lang"), str(tmp_path))
    assert last.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
    # By hand: the toxicity stage keeps what its scores say, the mixing stage what its plan says.
    w = toxicity.fit(docs, labels, "toxic", F.lit(True))
    plain = docs.select("doc_id", "text", "source")
    low = [str(r.doc_id) for r in toxicity.score(plain, w).collect() if r.score < corpus_pipeline.TOXICITY_MOST]
    assert sorted(low) == sorted(str(r.doc_id) for r in corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect())
    copies = Counter()
    for r in mixing.plan_copies(plain).collect():
        copies[str(r.doc_id), str(r.source)] += r.copies
    got = Counter((str(r.doc_id), str(r.source)) for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect())
    assert got == +copies


def test_pipeline_stages(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    w = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality", F.lit(True))
    want = {r.doc_id for r in quality.score(docs.select("doc_id", "text"), w).collect() if r.score >= corpus_pipeline.QUALITY_LEAST}
    assert {r.doc_id for r in kept.collect()} == want
    single = corpus_pipeline.jaccard_stage(spark, docs, sf)
    brute = brute_join([(r.doc_id, r.text, None) for r in docs.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in brute.values()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "jaccard", "mixing", "encoding"]
    final = corpus_pipeline.run(spark, sf).collect()
    own = tokenizer[1]
    by_id = {r.doc_id: r.text for r in docs.collect()}
    assert final and all(r.n_tokens == len(own.encode_ordinary(by_id[r.doc_id] or "")) for r in final[:50])
