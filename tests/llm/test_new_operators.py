"""Hard negatives, periodic runs and covering SimHash against brute force and awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import awkward, none
from tidewell.llm import hard_negatives, periodic, simhash
from tidewell.llm import queries as q

# ---- 11 hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, score string, bands string, ab string, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", "b", "a", "i") for r in rows], VECTORS)


def mined(rows, ids, positives=5, negatives=10, low=30, high=90):
    """Plain scoring of every pair of distinct rows."""
    ok = {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    ok = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in ok]
    out = []
    for i, lab, v in [r for r in ok if r[0] in ids]:
        s = {(-sum(a * b for a, b in zip(v, w)), j, m == lab) for j, m, w in ok if j != i}
        for p, pj in sorted((t, j) for t, j, alike in s if alike)[:positives]:
            inside = sorted((t, j) for t, j, alike in s if not alike and low * -p <= 100 * -t <= high * -p)[:negatives]
            out += [(i, pj, k + 1, j, -p, -t) for k, (t, j) in enumerate(inside)]
    return sorted(out)


def test_four_russians_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for most, dims in ((1, 8), (300, 64), (2**25, 24)):
        x, a = rng.integers(-most, most + 1, (50, dims)), rng.integers(-most, most + 1, (7, dims))
        planes, bits = hard_negatives.pack_planes(x)
        assert (hard_negatives.scores(planes, hard_negatives.subset_sums(a)) == x @ a.T).all()
        assert (hard_negatives._values(planes) == x).all() and planes.shape == (bits, dims // 8, 50)
    wide = np.hstack([a, rng.integers(-5, 5, (7, 8))])  # groups that the rows lack
    assert (hard_negatives.scores(planes, hard_negatives.subset_sums(wide)) == x @ a.T).all()


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice((0, 0, 0, 1, 2, 3)), [rng.choice((0.5, 0.25, rng.uniform(-1, 1))) for _ in range(rng.choice((3, 8, 13)))]) for i in range(400)]
    rows += [rows[i] for i in (0, 3, 40, 40, 41)] + [(i, 1, rows[5][2]) for i in range(500, 560)]
    rows += [(None, 1, [1.0]), (600, None, [1.0]), (601, 1, None), (602, 1, [1.0, None]), (603, 1, [float("nan")]), (604, 2, [float("inf")]), (605, 1, [])]
    df = vectors(spark, rows)
    want = mined(rows, {i for i in range(0, 1000, 20)})
    assert len(want) > 200
    for sizes in ({}, {"block": 37, "anchor_block": 4}):
        got = hard_negatives.mine(df.repartition(5), df.where("vec_id % 20 = 0"), **sizes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_awkward(spark):
    df = vectors(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [0.5])])
    assert hard_negatives.mine(df, df.where("vec_id = 0")).count() == 0  # the only positive has a negative score
    assert hard_negatives.mine(df.where("1 = 0"), df).count() == 0
    assert hard_negatives.mine(df, df.where("1 = 0")).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(vectors(spark, [(0, 1, [1e30]), (1, 1, [1.0])]), df).collect()


# ---- 12 periodic runs


def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(i + 1, j)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(rng):
    n, kind = rng.randint(0, 600), rng.randrange(7)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:  # one period
        unit = [rng.choice("abc") for _ in range(rng.randint(1, n // 2 + 1))]
        return (unit * n)[:n]
    if kind == 3:  # short periods out of step: a run of every second period
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
        a = (unit * 200)[: rng.randint(1, 250)]
        return a + a[rng.randint(0, 3) :] + a
    if kind == 4:  # Fibonacci word
        x, y = ["a"], ["b"]
        for _ in range(rng.randint(5, 11)):
            x, y = y, y + x
        return y
    if kind == 5:
        w = []
        while len(w) < n:
            unit = [str(rng.randint(0, 5)) for _ in range(rng.randint(1, 80))]
            w += (unit * rng.randint(1, 6))[: rng.randint(1, 300)]
        return w
    unit = ["a"] * rng.randint(1, 60) + ["b"] * rng.randint(0, 3)  # short runs inside long periods
    return unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]


def test_runs_equal_brute_force():
    rng = random.Random(12)
    n_runs = 0
    for _ in range(60):
        texts = [sample(rng) for _ in range(rng.randint(1, 5))]
        for w, (n, runs, rest) in zip(texts, periodic.collapsed([" ".join(w) for w in texts])):
            want = plain_runs(w)
            assert (n, runs, rest) == (len(w), want, kept(w, want))
            n_runs += len(want)
    assert n_runs > 500


def test_long_periods_and_boundaries():
    rng = random.Random(5)
    for p in (32, 33, 63, 64, 65, 128, 129, 1000, 2048, 2049):
        unit = [f"u{rng.randrange(10**6)}" for _ in range(p)]
        for extra in (-1, 0, 1):
            w = ["x"] + unit * 2 + unit[: max(0, extra)] + ["y"]
            w = w[:-2] + ["z"] if extra < 0 else w
            assert periodic.collapsed([" ".join(w)])[0][1] == ([(1, 2 * p + extra, p)] if extra >= 0 else [])
    assert periodic.collapsed(["a " * 11, "a " * 12, "a"]) == [(11, [], " ".join("a" * 11)), (12, [(0, 12, 1)], "a"), (1, [], "a")]


def test_minimizers_are_leftmost_least():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64) << np.uint64(1)
    assert periodic.minimizers(h, 16).tolist() == sorted({i + int(np.argmin(h[i : i + 16])) for i in range(285)})


def test_runs_awkward(spark):
    got = {(r.doc_id, r.n_words): r for r in periodic.find(awkward(spark)).collect()}
    assert len(periodic.find(awkward(spark)).collect()) == awkward(spark).count()
    assert got[(1, 0)].runs == [] and got[(1, 0)].collapsed == "" and got[(2, 0)].collapsed == "" and got[(4, 0)].collapsed == ""
    assert [tuple(x) for x in got[(5, 30_000)].runs] == [(0, 30_000, 1)] and got[(5, 30_000)].collapsed == "word"
    assert got[(7, 4)].collapsed == "à é \U0001f600 z\0q" and (None, 2) in got
    assert periodic.find(none(spark)).count() == 0


def test_runs_query_equals_plain_loops(spark, sf_dir):
    """Every document, and its digests, by loops over words."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = q.documents(spark, sf_dir).select("doc_id", "text").collect()
    want = {}
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 3000 else periodic.collapsed([" ".join(w)])[0][1]  # the long ones are held against SQL
        m = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[d] = (len(runs), *m, 1000 * m[1] // m[2] if runs else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(kept(w, runs)))
    got = q.op12_periodic_runs(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got} == want


# ---- 13 covering SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=4):
    """(doc_id, fingerprint) to the least id reachable, by a search over all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    low = {f: min((d for d, g in rows if g == f and d is not None), default=None) for f in fps}
    near = {f: [g for g in fps if (f ^ g).bit_count() <= radius] for f in fps}
    out = {}
    for f in fps:
        if f not in out:
            seen, todo = {f}, [f]
            while todo:
                new = [g for g in near[todo.pop()] if g not in seen]
                seen.update(new)
                todo += new
            least = min((low[g] for g in seen if low[g] is not None), default=None)
            out |= dict.fromkeys(seen, least)
    return out


def test_masks_cover_every_choice_of_bits():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert not all(m & sum(1 << b for b in bits) for m in masks)
    masks, rng = simhash.covering_masks(4), random.Random(1)
    for _ in range(20_000):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert not all(m & x for m in masks)


def test_fingerprints_equal_plain_counts(spark, sf_dir):
    texts = [r.text for r in q.documents(spark, sf_dir).select("text").collect()] + [None, "", " \t", "A", "a b C d", "É é A a", "x " * 9_000]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def _classes(spark, codes, **options):
    signed = [simhash._signed(c) for c in codes]
    df = spark.createDataFrame([(c, 1 + i % 3) for i, c in enumerate(signed)], "fp long, copies long")
    return {r.fp & (2**64 - 1): r.comp & (2**64 - 1) for r in simhash.classes(df, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"block": 8, "most": 1}])
def test_classes_equal_all_pairs(spark, options):
    """Chains, stars and clumps of codes, in buckets cut into small parts and with links told one at a time."""
    rng = random.Random(7)
    codes = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(rng.choice((1, 5, 40))):  # a chain of small steps
            codes.add(c)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                c ^= 1 << b
    clump = rng.getrandbits(64)
    codes |= {clump ^ sum(1 << b for b in rng.sample(range(20), 6)) for _ in range(60)}  # six and more bits apart, many in one bucket
    codes = sorted(codes)
    groups = plain_components(list(enumerate(codes)))
    got = _classes(spark, codes, **options)
    same = lambda f: got.get(f, ("alone", f))
    assert all((groups[a] == groups[b]) == (same(a) == same(b)) for a, b in itertools.combinations(codes, 2))
    assert 1 < len(set(got.values())) < len(got)


def test_near_copies_of_documents(spark, sf_dir):
    docs = q.documents(spark, sf_dir).select("doc_id", "text").collect()
    want = plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    got = q.op13_simhash_covering(spark, sf_dir).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    for d, t in docs:
        f = plain_fingerprint(t)
        assert (by_id[d].fingerprint, by_id[d].component_id) == (f"{f:016x}", want[f])
    assert any(r.component_id != r.doc_id for r in got)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**5)}" for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(400)] = f"v{i}"
        rows.append((i + 10, " ".join(w)))
    rows += [(i + 1000, f"other {i} text number {i * i}") for i in range(50)] + [(5, None), (3, ""), (None, " ".join(base))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, comp string")
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    got = simhash.near_copies(df).collect()
    assert sorted(((r.doc_id or -1), r.component_id) for r in got) == sorted(((d or -1), want[plain_fingerprint(t)]) for d, t in rows)


def test_simhash_awkward(spark):
    got = simhash.near_copies(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert {1, 2, 4} <= set(zero) and set(zero.values()) == {1}
    assert simhash.near_copies(none(spark)).count() == 0
    lone = spark.createDataFrame([(None, "one text of no id")], "doc_id long, text string")
    assert simhash.near_copies(lone).first().component_id is None
