"""Operators on tables: edge cases (nulls, empty, repeated, clashing columns) and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowspark.llm import exact_topk, kneser_ney, lm_scoring, minhash_dedup, pii, quality_rules, sentencepiece_sampling, source_mixing, token_counts, warc
from flowspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, count=80):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    rows = []
    for i in range(count):
        if rows and r.random() < 0.4:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(r.choice(words) for _ in range(r.choice((60, 90, 150))))
        rows.append((i, text, r.choice(["en", "fr"]), r.choice(["s1", "s2", "s3"]), len(text)))
    return rows


EDGES = [(None, "one two three four five six", None, None, None), (1000, None, "en", "s1", 0), (1001, "", None, "s1", 0), (1002, " \n ", "en", None, 3), (1003, "Hi", "en", "s1", 2), (1003, "Hi", "en", "s1", 2), (1004, "word " * 30000, "en", "s2", 150000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + EDGES, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x}
    assert {x.u: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = [(1, k) for k in range(2, 3000)] + [(k, 5000 + k) for k in range(2, 40)] + [(4, 4), (None, 3), (7, 1), (1, 2)]
    assert {x.root for x in components(spark.createDataFrame(star, "u long, v long")).collect()} == {1}


@pytest.mark.parametrize("rows", [100_000, 50])
def test_components_in_one_task_or_by_stars(spark, monkeypatch, rows):
    """Chains in random order, trees and a large star, against a search; few edges take no step of their own."""
    from flowspark.llm import components as module

    steps = []
    monkeypatch.setattr(module, "ROWS", rows)
    monkeypatch.setattr(module, "_is_stars", lambda edges, own=module._is_stars: steps.append(1) or own(edges))
    r = random.Random(3)
    names = r.sample(range(-(1 << 61), 1 << 61), 900)
    edges = [(names[k], names[k + 1]) for k in range(200)] + [(names[300], names[k]) for k in range(301, 700)] + [(names[k], names[r.randrange(700, k)]) for k in range(701, 850)]
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    want, seen = {}, set()
    for u in sorted(near):
        todo = [] if u in seen else [u]
        seen.add(u)
        while todo:
            for v in near[todo.pop()] - seen:
                seen.add(v)
                want[v] = u
                todo.append(v)
    table = spark.createDataFrame([*edges, (5, 5), (None, 4), (4, None), *edges[:9]], "u long, v long")
    assert {x.u: x.root for x in module.components(table).collect()} == want and bool(steps) == (rows == 50)
    assert module.components(table.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, percent):
    rows = docs.collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = minhash_dedup.link(docs, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    kept = [r.doc_id for r in minhash_dedup.dedupe(docs, percent).collect()]
    assert Counter(kept) == Counter([*{find(k) for k in sets}, None])


def test_near_duplicates_of_one_large_family(spark):
    """More near copies than a block holds, at all similarities."""
    r = random.Random(5)
    base = ["w%d" % k for k in range(120)]
    rows = []
    for i in range(800):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 5, 8))):
            w[r.randrange(120)] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(800))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(800):
        for b in range(a):
            if find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = minhash_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: find(k) for k in range(800)}


def test_pages_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    """Pages of similarity 0.6 link with nothing, and the rows that reach blocks do not grow with their square; true copies among them are found."""
    seen, plain = [], minhash_dedup._blocks
    monkeypatch.setattr(minhash_dedup, "_blocks", lambda *args: (out := plain(*args), seen.append(out.count()))[0])
    template = " ".join("t%d" % k for k in range(150))
    for count in (700, 1400):
        rows = [(i, f"{template} " + " ".join("p%d_%d" % (i, k) for k in range(50))) for i in range(count)]
        rows += [(10_000 + i, f"{template} " + " ".join("p%d_%d" % (i, k) for k in range(48)) + " other end") for i in range(0, count, 100)]
        found = {x.doc_id: x.component_id for x in minhash_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
        assert found == {i: i % 10_000 for i, _ in rows}
    assert seen[1] <= 2.5 * seen[0] + 100


def test_exact_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-0.5, 0.25, 0.013, -0.02, 0.5)) for _ in range(4)], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [1.0, None, 0.0, 0.0], "x"), (302, [math.nan, 0.0, 0.0, 0.0], "x"), (320, [math.inf, 0.0, 0.0, 0.0], "x"), (340, [1.0], "x"), (341, [2.0], "x"), (360, [1e30, 1e30, 0.0, -1e30], "x"), (None, [0.0] * 4, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(20)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(b) == len(a))[:20]
            top = 2**63 - 1
            want |= {(q, k + 1): (c, max(-top - 1, min(top, -s))) for k, (s, c) in enumerate(scored)}
    # broadcast, and in tiles of a few queries
    for room in (exact_topk.GROUP_BYTES, 200):
        found = {(x.query_id, x.rank): (x.vec_id, x.score) for x in exact_topk.top_k(vectors, F.col("vec_id") % 20 == 0, group_bytes=room).collect()}
        assert found.keys() == want.keys()
        assert all(found[k] == want[k] for k in want if k[0] != 360 and abs(want[k][1]) < 2**62)
    assert exact_topk.top_k(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("room", [exact_topk.GROUP_BYTES, 100])
def test_exact_top_k_of_repeated_ids(spark, room):
    """Each query row has its own list, which holds every candidate row of another id, repeated ones too."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0, 1.0]), (40, [1.0, 1.0])] + [(k, [k / 8, 1.0]) for k in (1, 1, 3, 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = Counter((x.query_id, x.rank, x.vec_id, x.score) for x in exact_topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=3, group_bytes=room).collect())
    want = Counter()
    for q, a in rows:
        if q % 20 == 0:
            scored = sorted((-sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b)), c) for c, b in rows if c != q)
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:3]))
    assert found == want


def _lm_scores(rows, train):
    """The documented formula written out: (doc_id, n_tokens, n_known, base, score) of each of rows, learning from train."""
    tokens = lambda t: [*(t or "").translate(LOWER).split(), "\0"]
    c, pairs = Counter(), Counter()
    for t in train:
        own = tokens(t)
        c.update(own)
        pairs.update(zip(["\1", *own], own))
    n, mass = Counter(), Counter()
    for (v, _), k in pairs.items():
        n[v] += k
        mass[v] += k - 0.5
    z = sum(c.values()) + 0.1 * (len(c) + 1)
    down = lambda x, least: least * 1.5 ** math.floor(math.log(x / least) / math.log(1.5) + 1e-9)
    up = lambda x: 1.5 * down(x, 0.5)
    out = []
    for i, t in rows:
        own, base, score = tokens(t), 0.0, 0.0
        for v, w in zip(["\1", *own], own):
            p = (c[w] + 0.1) / z
            base += math.log10(p)
            if n[v]:
                of = n[v] if v == "\1" else up(n[v])
                p *= 1 - 0.5 * min(up(mass[v]), of) / of
                if pairs[v, w]:
                    p += 0.5 * (down(pairs[v, w], 1.0) - 0.5) / of
            score += math.log10(p)
        out.append((i, len(own), sum(c[w] > 0 for w in own), round(base, 4), round(score, 4)))
    return sorted(out, key=str), sum(c.values())


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_lm_scores(docs, empty, broadcast):
    """Against the formula written out; with 80 bits an item the filter has no false positives. Both ways, broadcast and by buckets."""
    settings = lm_scoring.Settings(broadcast=broadcast, chunk=5000, bits=80)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    want, n = _lm_scores(rows, [t for i, t in rows if not held(i)])
    model = lm_scoring.fit(docs.where(~lm_scoring.held_out(F.col("doc_id"))), settings)
    found = lm_scoring.score(docs, model).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in found), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[k] - b[k]) < 0.002 for a, b in zip(got, want) for k in (3, 4))
    assert {r.train_tokens for r in found} == {n}
    assert sum(r.score for r in found if held(r.doc_id)) > sum(r.base_score for r in found if held(r.doc_id))
    nothing = lm_scoring.fit(empty, settings)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm_scoring.score(docs, nothing).collect())
    assert lm_scoring.score(empty, model).count() == 0


def test_lm_scores_do_not_depend_on_how_the_model_lies(spark):
    """Broadcast or in buckets, in small chunks or one, with many contexts spread or BEGIN alone: the same scores."""
    r = random.Random(9)
    rows = [(i, " ".join("w%d" % (r.randrange(300) if r.random() < 0.7 else 1) for _ in range(80)) + f" once{i} again{i}") for i in range(200)]
    rows += [(500, "w1 " * 20_000), (501, None), (502, ""), (None, "w1 w2"), (500, "w1 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores = lambda **k: sorted(((x.doc_id or -1, round(x.score, 6)) for x in lm_scoring.score(docs, lm_scoring.fit(docs, lm_scoring.Settings(**k))).collect()))
    want = scores()
    assert scores(broadcast=0) == scores(broadcast=0, chunk=700) == want
    exact = scores(bits=80)
    for spread in (1000, 0.001):
        assert scores(bits=80, broadcast=0, spread=spread) == exact
    assert all(math.isclose(a[1], b[1], abs_tol=3, rel_tol=0.01) for a, b in zip(exact, want))


def test_log_bloom_holds_what_was_put_in():
    keys = lm_scoring.mix(np.arange(5000).astype(np.uint64))
    levels = np.random.default_rng(0).integers(1, 9, 5000)
    order = np.argsort(keys)
    keys, levels = keys[order], levels[order]
    k, v = lm_scoring.unpack(lm_scoring.pack(keys, levels))
    assert np.array_equal(k, keys) and np.array_equal(v, levels)
    shards = {}
    for b in range(8):
        own = lm_scoring.bucket_of(keys, 8) == b
        size = 10 * int(levels[own].sum())
        shards[b] = (size, lm_scoring.shard(keys[own], levels[own], size).tobytes())
    bloom = lm_scoring.LogBloom(shards, 8)
    assert (bloom.levels(keys) >= levels).all() and (bloom.levels(keys) == levels).mean() > 0.95
    assert (bloom.levels(lm_scoring.mix(np.arange(10**6, 10**6 + 5000).astype(np.uint64))) > 0).mean() < 0.05


def test_tokens_and_pii_tables(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = token_counts.count_tokens(docs.withColumn("N_Tokens", F.lit("clash")), path).collect()
    assert len(found) == docs.count() and all(r.n_bytes == len((r.text or "").encode()) for r in found)
    assert {r.doc_id for r in found if r.over_limit} >= {1004}
    assert token_counts.count_tokens(empty, path).count() == 0
    tagged = pii.tag(docs.withColumn("spans", F.lit(1))).collect()
    assert len(tagged) == docs.count() and all(r.spans == "" and r.n_email == 0 for r in tagged)
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[1000] is None and masked[1003] == "Hi" and pii.mask(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    line, r = "Buy now and save", random.Random(4)
    rows = [(i, "\n".join([" ".join(r.choice("abcdefgh") + str(r.randrange(10**6)) for _ in range(60)), "  buy NOW and  save ", "x y" if i % 2 else "z"]), "en", "big" if i else None, 0) for i in range(60)]
    rows += [(100 + i, "\n".join([line] * 20), "en", "big", 0) for i in range(3)] + [(200 + i, rows[0][1], "en", "small", 0) for i in range(40)]
    table = spark.createDataFrame(rows + EDGES, SCHEMA).withColumn("q_kept", F.lit("clash")).withColumn("lines", F.lit(0))
    for limits in (quality_rules.Limits(), quality_rules.Limits(broadcast_rows=0)):
        found = {r.doc_id: r for r in quality_rules.judge(table, limits).collect()}
        assert all(found[i].q_kept and found[i].q_removed_words == 4 + (2 if i % 2 else 1) for i in range(1, 60))
        assert found[0].q_kept and found[0].q_removed_words == 0  # a host of its own
        assert found[200].q_kept and found[200].q_removed_words == 0  # copies are one document
        assert found[100].q_base_failed and not found[1000].q_kept and not found[1004].q_kept
        texts = {r.doc_id: r.text for r in quality_rules.clean(table, limits).collect()}
        assert set(texts) == {*range(60), *range(200, 240)}
        assert texts[1].rstrip("\n") == rows[1][1].split("\n")[0] and texts[0] == rows[0][1]
        assert quality_rules.judge(empty, limits).count() == 0 and quality_rules.clean(empty, limits).count() == 0


def test_mixing(docs, empty):
    found = source_mixing.mix(docs.withColumn("MIX_size", F.lit("clash"))).collect()
    sizes = defaultdict(int)
    for r in found:
        assert r.mix_size == len((r.text or "").split())
        sizes[r.source] += r.mix_size
    order = sorted(s for s in sizes if s is not None) + [None]
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    capped = set()
    while True:
        share = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in sizes if s not in capped))
        more = {s for s in sizes if s not in capped and share * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for r in found:
        want = 3 * sizes[r.source] if r.source in capped else share * weight[r.source]
        assert math.isclose(r.mix_target, want) and r.mix_source_size == sizes[r.source]
        rate = want / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= r.mix_copies <= math.ceil(rate) <= 3
    assert Counter((r.doc_id, r.mix_copies) for r in found) == Counter((r.doc_id, r.mix_copies) for r in source_mixing.mix(docs.repartition(1)).collect())
    assert source_mixing.emit(docs).count() == sum(r.mix_copies for r in found)
    assert source_mixing.mix(empty).count() == 0 and source_mixing.emit(empty).count() == 0


@pytest.mark.parametrize("size", [1_000_000_000 // 4, 10**9, 10**15, 6 * 10**17])
def test_targets_of_large_sources(spark, size):
    """Shares by weight 5, 2, 1, the first of which is above its cap in the first row: beyond 32 and 64 bits as products."""
    sizes = spark.createDataFrame([("a", size // 100, 0), ("b", size, 1), ("c", size, 2)], "source string, source_size long, rank long")
    found = {r.source: r.target for r in source_mixing.targets(sizes).collect()}
    rest = 2 * size + size // 100 - 3 * (size // 100)
    assert found == {"a": 3.0 * (size // 100), "b": pytest.approx(rest * 2 / 3), "c": pytest.approx(rest / 3)}


def test_encoding(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_sampling.encode(docs.withColumn("pieces", F.lit(0)), path, seed=3)
    back = sentencepiece_sampling.decode(coded, path).collect()
    assert all(r.decoded == r.text and (r.n_pieces is None) == (r.text is None) for r in back) and len(back) == docs.count()
    again = {r.doc_id: r.pieces for r in sentencepiece_sampling.encode(docs.repartition(1), path, seed=3).collect()}
    assert all(again[r.doc_id] == r.pieces for r in back)
    assert sentencepiece_sampling.encode(empty, path).count() == 0


def test_classifier(spark, docs, empty):
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,), (3,)], "doc_id long")
    out = [kneser_ney.classify(docs.withColumn("kept", F.lit(0)), trusted, kneser_ney.Settings(max_train_docs=30, broadcast_rows=n)) for n in (10**6, 0)]
    a, b = (Counter((r.doc_id, r.n_tokens, None if r.perplexity is None else round(r.perplexity, 6), r.kept) for r in x.collect()) for x in out)
    assert a == b and sum(a.values()) == docs.count()
    noise = spark.createDataFrame([(5000 + k, " ".join(f"zz{k}{j}" for j in range(60)), "en", "s1", 0) for k in range(5)], SCHEMA)
    found = {r.doc_id: r.kept for r in kneser_ney.classify(docs.unionAll(noise), trusted, kneser_ney.Settings(max_train_docs=30)).collect()}
    assert not any(found[5000 + k] for k in range(5)) and np.mean([found[k] for k in range(60)]) > 0.8
    assert kneser_ney.classify(empty, trusted).count() == 0
    assert all(r.kept and r.perplexity is None for r in kneser_ney.classify(docs, trusted.where("false")).collect())


def test_classifier_models_every_trusted_language(spark):
    """A language with a few trusted documents among many of another still has a model, and its junk goes."""
    r = random.Random(6)
    rows = [(i, " ".join("e%d" % r.randrange(50) for _ in range(40)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join("i%d" % r.randrange(20) for _ in range(40)), "is") for i in range(6)]
    rows += [(2000, " ".join(f"zz{k}" for k in range(40)), "is"), (3000, "n1 n2 n3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 1006 OR doc_id = 3000").select("doc_id")
    found = {x.doc_id: x for x in kneser_ney.classify(docs, trusted, kneser_ney.Settings(max_train_docs=32)).collect()}
    assert len(found) == len(rows) and all(x.perplexity is not None for x in found.values())
    assert not found[2000].kept


def _kneser_ney(train):
    """Interpolated modified Kneser-Ney trigrams written out: log10 probability of a text."""
    tokens = lambda t: ["\1", "\1", *(t or "").translate(LOWER).split(), "\0"]
    grams = [Counter(), Counter(), Counter()]
    for t in train:
        w = tokens(t)
        grams[2].update(zip(w, w[1:], w[2:]))
    grams[1].update(x[1:] for x in grams[2])
    grams[0].update(x[1:] for x in grams[1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return [max(0.1, min(k - (k + 1) * y * n[k + 1] / n[k], k - 0.1)) if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]

    levels = []
    for c in grams:
        total, off, d = Counter(), Counter(), discounts(c)
        for x, v in c.items():
            total[x[:-1]] += v
            off[x[:-1]] += d[min(v, 3) - 1]
        levels.append((c, total, off, d))

    def p(x):
        c, total, off, d = levels[len(x) - 1]
        lower = p(x[1:]) if len(x) > 1 else 1 / (len(c) + 1)
        h = x[:-1]
        if h not in total:
            return lower
        return (max(0, c[x] - d[min(c[x], 3) - 1]) if x in c else 0) / total[h] + off[h] / total[h] * lower

    return lambda t: sum(math.log10(p(x)) for x in zip(tokens(t), tokens(t)[1:], tokens(t)[2:]))


def test_classifier_equals_plain_kneser_ney(spark, docs):
    """The model of some texts and the perplexities of all, in both forms, against the formulas written out."""
    r = random.Random(4)
    text = lambda n: " ".join("w%d" % min(r.randrange(30), r.randrange(30)) for _ in range(n))
    train = [(lang, text(r.randrange(1, 60))) for lang in ("en", "fr", None) for _ in range(12)] + [("en", None), ("fr", "")]
    model = kneser_ney.fit(spark.createDataFrame(train, "lang string, text string"))
    rows = [(i, text(40) + " unseen" * (i % 2), ("en", "fr", None, "xx")[i % 4]) for i in range(20)] + [(30, None, "en"), (31, "w1 " * 3000, "fr")]
    want = {lang: _kneser_ney([t for k, t in train if k == lang]) for lang in ("en", "fr", None)}
    for n in (10**6, 0):
        found = kneser_ney.perplexities(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, kneser_ney.Settings(broadcast_rows=n)).collect()
        assert len(found) == len(rows)
        for x in found:
            assert x.log10_prob is None if x.lang == "xx" else math.isclose(x.log10_prob, want[x.lang](x.text), rel_tol=1e-9), (x, n)


def test_classifier_model_reaches_the_driver_by_ranges(spark, monkeypatch):
    """Never as one Arrow table, of which sorting makes copies; keys in unsigned order."""
    r = random.Random(6)
    rows = {r.randrange(-(1 << 63), 1 << 63): r.random() for _ in range(5000)} | {-(1 << 63): 0.5, (1 << 63) - 1: 0.25, 0: 1.0, -1: 2.0}
    model = spark.createDataFrame(list(rows.items()), "key long, x double").repartition(7)
    monkeypatch.setattr(type(model), "toArrow", lambda self: pytest.fail("gathered whole"))
    keys, values = kneser_ney._gathered(model, model.count())
    assert dict(zip(keys.view(np.int64).tolist(), values.tolist(), strict=True)) == rows and (keys[1:] > keys[:-1]).all()
    docs = spark.createDataFrame([(k, "a b c", "en") for k in range(9)], "doc_id long, text string, lang string")
    assert kneser_ney.classify(docs, docs).count() == 9


def test_classifier_holds_out_at_every_size(spark):
    """Of few trusted documents too a share sets the threshold, so junk goes; the model and its limits do not depend on the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = kneser_ney.classify(docs, labels.where("quality = 1"), keep_text=False).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {x.quality: x.kept for x in out.collect()}
    assert kept[0] < 0.25 and kept[1] > 0.9


def test_model_sums_to_one(spark):
    text = spark.createDataFrame([(7, "a b a c a b"), (7, "b a a")], "x long, text string").withColumn("lang", F.lit("en"))
    model = kneser_ney.fit(text)
    probes = spark.createDataFrame([(k, f"a b {w}".strip()) for k, w in enumerate(["a", "b", "c", "q", ""])], "doc_id long, text string").withColumn("lang", F.lit("en"))
    logs = {r.doc_id: r for r in kneser_ney.perplexities(probes, model).collect()}
    from flowspark.llm.common import Texts
    import pyarrow as pa

    asked, first = kneser_ney._asked(Texts.of(pa.array([f"a b {w}".strip() for w in ["a", "b", "c", "q", ""]])), kneser_ney.languages(pa.array(["en"] * 5)))
    rows = {r.key: r.x for r in model.collect()}
    x = [np.array([rows.get(int(k), np.nan) for k in keys.view(np.int64)]) for keys in asked]
    p = kneser_ney._probability(x)
    third = [p[first[k] + 2] for k in range(5)]
    assert math.isclose(sum(third), 1.0, rel_tol=1e-9) and all(r.log10_prob < 0 for r in logs.values())


def test_warc_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, None, None), (None, "http://b/", "")], "page_id long, url string, html string").withColumn("record", F.lit(0))
    found = warc.derive(warc.responses_of(pages), keep=("page_id",)).collect()
    assert len(found) == 8 and Counter(r.warc_type for r in found) == {"metadata": 4, "conversion": 4}
    assert {r.block.decode() for r in found if r.warc_type == "conversion"} == {"x", ""}
    one = warc.responses_of(pages.limit(1)).collect()[0]
    raw = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", one.record_id), ("WARC-Target-URI", one.target_uri), ("WARC-Date", one.warc_date)], bytes(one.block))
    (tmp_path / "a.warc").write_bytes(raw + raw[:-40])
    back = warc.read(spark, str(tmp_path / "a.warc")).collect()
    assert [(r.record_id, r.target_uri, bytes(r.block)) for r in back] == [(one.record_id, one.target_uri, bytes(one.block))]
    assert warc.derive(warc.responses_of(pages.where("false"))).count() == 0


def test_warc_source_headers_and_compressed_files(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Target-URI", "http://a/"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Payload-Digest", "sha1:DECLARED"), ("WARC-Block-Digest", "sha1:BLOCK")]
    one = warc.record(headers, block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    found = warc.derive(warc.read(spark, str(tmp_path / "a.warc.gz"))).collect()
    assert Counter(r.warc_type for r in found) == {"metadata": 2, "conversion": 2}
    meta = next(bytes(r.block).decode() for r in found if r.warc_type == "metadata")
    for line in ("warc-source-ip-address: 10.0.0.1", "warc-source-payload-digest: sha1:DECLARED", "warc-source-block-digest: sha1:BLOCK"):
        assert line in meta.split("\r\n")
    (tmp_path / "b.warc.zst").write_bytes(b"\x28\xb5\x2f\xfd" + bytes(50))
    with pytest.raises(Exception, match="neither a WARC file"):
        warc.read(spark, str(tmp_path / "b.warc.zst")).collect()
