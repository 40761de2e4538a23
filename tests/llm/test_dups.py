"""Near copies, near vectors and repeated passages, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from eavspark.llm import embed_dedup, ngram_join, substring
from eavspark.llm.shared import block_pairs, components, plausible
from eavspark.llm.words import grams, mix, word_hashes, words_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rep long, component long, key long, size long"
REST = (None,) * 8


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(nodes, links):
    parent = {x: x for x in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in nodes}


def brute(rows, words=5, least=0.8):
    """Links by position, from sets of n-grams."""
    held = [frozenset(grams(word_hashes(t), words).tolist()) for _, t in rows]
    return [(i, j) for j in range(len(rows)) for i in range(j) if held[i] and held[j] and len(held[i] & held[j]) >= least * len(held[i] | held[j])]


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(400)) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice([1, 3, 5, 40, 120, 300]))) for k in range(60)]
    base = prose(rng, 200)
    rows += [(100 + k, edited(rng, base, rng.randrange(5))) for k in range(40)]  # a dense group of near copies
    rows += [(200 + k, rows[55][1]) for k in range(15)]  # exact copies
    rows += [(300, rows[50][1].upper() + "!!"), (301, "two words"), (302, "two words"), (303, "Two, words"), (304, "two other")]
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_copies_are_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # groups are cut into many blocks, with the same result
        monkeypatch.setattr(ngram_join, "block_pairs", lambda *a: block_pairs(*a, most_rows=7))
    rows = corpus()
    df = spark.createDataFrame([(k, t, *REST) for k, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in ngram_join.classes(df).collect()}
    links = brute(rows)
    n, of = defaultdict(int), joined([k for k, _ in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    for i, j in links:
        n[rows[i][0]] += 1
        n[rows[j][0]] += 1
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == {k: (of[k], n[k]) for k, _ in rows}
    assert sorted(k for k, r in got.items() if r.kept) == sorted(set(of.values()))


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, None), (5, "same text here"), (5, "same text here"), (None, "same text here"), (None, "other"), (6, "w " * 90_000)]
    got = ngram_join.classes(spark.createDataFrame([(k, t, *REST) for k, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.class_id, r.n_links, r.kept))
    assert by[1] == [(1, 0, True)] and by[2] == [(2, 0, True)] and by[3] == [(3, 0, True)] and by[6] == [(6, 0, True)]
    assert sorted(by[5]) == [(5, 2, False), (5, 2, True)] and sorted(by[None], key=str) == [(5, 2, False), (None, 0, True)]
    assert ngram_join.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefixes_reach_the_recall():
    depths = ngram_join.prefixes(0.8, 0.9995)
    assert 1 - np.prod([1 - 0.8**d for d in depths]) >= 0.9995
    depths[depths.index(min(depths))] += 1  # one step less falls short
    assert 1 - np.prod([1 - 0.8**d for d in depths]) < 0.9995


def test_signature_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 400, np.uint32)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 32, 40, np.uint32)])
    same = np.mean(ngram_join.signature(a, 512) == ngram_join.signature(b, 512))
    assert abs(same - 360 / 440) < 0.08


def test_shared_counts():
    rng = np.random.default_rng(5)
    held = [set(rng.integers(0, 60, rng.integers(1, 50)).tolist()) for _ in range(40)]
    of = np.concatenate([[k] * len(s) for k, s in enumerate(held)])
    what = np.concatenate([sorted(s) for s in held]).astype(np.uint32)
    got = ngram_join.shared_counts(of, what, 40)
    assert all(got[i, j] == len(held[i] & held[j]) for i in range(40) for j in range(40) if i != j)


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined({x for e in edges if e[0] != e[1] for x in e}, edges[:-1] and [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plausible_links(spark):
    """Members of one key that are near each other are connected, also where the key's first is unlike them."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2, (6, 256), np.uint8)
    bits = np.array([c ^ (rng.random(256) < 0.02) for c in centres for _ in range(10)])
    sketch = np.packbits(bits, axis=1).view(np.int64)
    rows = [(k, sketch[k].tolist()) for k in range(60)]
    members = spark.createDataFrame([(k % 2, k) for k in range(60)], "key long, node long")
    for rounds in (8, 1):
        got = plausible(members, spark.createDataFrame(rows, "node long, sketch array<long>"), 40, rounds).collect()
        of = joined(range(60), [(r.a, r.b) for r in got])
        near = [(a, b) for b in range(60) for a in range(b % 2, b, 2) if (bits[a] ^ bits[b]).sum() <= 40]
        assert len(near) == 6 * 20 and all(of[a] == of[b] for a, b in near)
        assert rounds == 1 or len(set(of.values())) == 12


def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    rows = [(k, c, k % 3) for k, c in enumerate(centres)]
    for k in range(30):
        for j in range(6):
            rows.append((100 + 10 * k + j, centres[k] + rng.normal(size=24) * np.linalg.norm(centres[k]) * rng.choice([0.01, 0.03, 0.05]), k % 3 if j else (k + 1) % 3))
    rows += [(900 + j, centres[4], 1) for j in range(5)] + [(950, centres[4] * 1e200, 1), (951, centres[4] * 1e-200, 1)]
    return [(k, [float(x) for x in v], label) for k, v, label in rows]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_vectors_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(embed_dedup, "block_pairs", lambda *a, **b: block_pairs(*a, most_rows=4))
    rows = vectors()
    got = {r.vec_id: r for r in embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    unit = {k: np.array(v) / np.abs(v).max() for k, v, _ in rows}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links = [(a[0], b[0]) for i, b in enumerate(rows) for a in rows[:i] if a[2] == b[2] and unit[a[0]] @ unit[b[0]] >= 0.98]
    assert len(links) > 150
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    of = joined(unit, links)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (n[k], of[k], of[k] == k) for k in unit}
    assert got[950].n_links == got[951].n_links == n[950] >= 6


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1),
            (10, [], 1), (11, [1.0, 0.0], 2), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [-0.0, 3.0], 2), (13, [0.0, 3.0], 2)]
    got = embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "n": F.lit(2), "key": F.lit(3)})).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.component_id, r.n_links > 0, r.kept) for r in got}
    alone = {k: (k, False, True) for k in (1, 2, 3, 4, 5, 6, 9, 10, 11)}
    assert {k: by[k] for k in alone} == alone and by[8] == (7, True, False) and by[13] == (12, True, False) and by[7] == (7, True, True) and by[None] == (7, True, False)
    assert embed_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rows_of_one_id(spark):
    """Rows that share an id are vectors of their own."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.02], 1), (2, [0.0, 1.0], 1), (None, [0.0, -1.0], 1)]
    got = embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False)]


@pytest.mark.parametrize("dim", [2, 24, 64, 200])
def test_settings_reach_the_recall(dim):
    rng = np.random.default_rng(dim)
    x, z = rng.normal(size=(2, 3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    exact = np.abs(np.linalg.norm(y, axis=1) - 1) < 1e-9  # where z was not nearly x
    x, y = x[exact], y[exact]
    for rows in (100, 10**7):
        tables, hashes = embed_dedup.settings(rows, dim)
        (a, s), (b, t) = embed_dedup.buckets(x, tables, hashes, 1), embed_dedup.buckets(y, tables, hashes, 1)
        meet = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any((1, 2))
        assert meet.mean() > 0.999 and np.bitwise_count((s ^ t).view(np.uint64)).sum(1).max() <= embed_dedup.near_bits()


def test_hadamard_keeps_lengths_and_mixes():
    x = np.random.default_rng(1).normal(size=(4, 64))
    y = embed_dedup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embed_dedup.hadamard(y), x)


def planted(seed=11):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice([5, 80, 400]))) for k in range(40)]
    passages = [prose(rng, n) for n in (51, 60, 90, 150)]
    held = {}
    for p, passage in enumerate(passages):
        for k in range(6):
            exact = k < 4
            text = passage if exact else edited(rng, passage, len(passage.split()) // 25)
            doc = 100 + 10 * p + k
            before = prose(rng, rng.randrange(0, 60))
            rows.append((doc, f"{before} {text} {prose(rng, rng.randrange(0, 60))}"))
            held[doc] = (p, len(before.split()), len(passage.split()), exact)
    return rows, held


def test_planted_passages(spark):
    rows, held = planted()
    df = spark.createDataFrame([(k, t, *REST) for k, t in rows], SCHEMA).coalesce(1)
    got = substring.passages(df).collect()
    caught = defaultdict(set)
    for r in got:
        caught[r.doc_id].update(range(r.start, r.stop))
        assert r.stop - r.start >= 50 and held[r.doc_id][0] == held[r.of_doc_id][0]  # clean documents are left alone
    for doc, (p, start, n, exact) in held.items():
        if doc % 10:  # all but the first, which is where the passage comes first
            share = len(caught[doc] & set(range(start, start + n))) / n
            assert share == 1 if exact else share > 0.85, (doc, share)
            assert len(caught[doc] - set(range(start, start + n))) <= 3
    assert not any(doc % 10 == 0 for doc in caught)


def test_cut_texts(spark):
    rows, held = planted()
    df = spark.createDataFrame([(k, t, *REST) for k, t in rows], SCHEMA).coalesce(1)
    out = {r.doc_id: r for r in substring.remove(df).collect()}
    texts = dict(rows)
    assert len(out) == len(rows) and substring.remove(df).columns == df.columns
    for k, t in texts.items():
        if k not in held or k % 10 == 0:
            assert out[k].text == t
        elif held[k][3]:
            assert len(out[k].text.split()) <= len(t.split()) - held[k][2] + 2


def test_passages_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(70))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "again " * 5000), (5, "again " * 5000), (6, text + " middle " + text), (7, "short")]
    df = spark.createDataFrame([(k, t, *REST) for k, t in rows], SCHEMA).coalesce(1)
    got = substring.passages(df).collect()
    assert {r.doc_id for r in got} == {3, None, 4, 5, 6}
    six = [(r.start, r.stop) for r in got if r.doc_id == 6]
    assert (0, 70) in six and (71, 141) in six
    left = {r.doc_id: r.text for r in substring.remove(df).collect()}
    assert left[6].strip() == "middle" and left[1] is None and left[2] == "" and left[7] == "short"
    assert substring.passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_seeds_are_shared():
    """Texts that share WINDOW + SEED - 1 words in a row share a seed there."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        run = rng.integers(0, 1 << 60, substring.WINDOW + substring.SEED - 1).astype(np.uint64)
        sides = [np.concatenate([rng.integers(0, 1 << 60, 30).astype(np.uint64), run, rng.integers(0, 1 << 60, 30).astype(np.uint64)]) for _ in range(2)]
        a, b = (set(substring.seeds(s)[1].tolist()) for s in sides)
        assert a & b
    one, two = rng.integers(0, 1 << 60, (2, 40)).astype(np.uint64)
    at, found = substring.seeds(np.concatenate([one, two[:7], two]), np.array([40, 0, 7, 40]))
    apart = [substring.seeds(t) for t in (one, two)]
    assert set(found.tolist()) >= set(apart[0][1].tolist()) | set(apart[1][1].tolist()) and not set(at.tolist()) & {*range(33, 47), *range(80, 87)}


def test_chains_of_few():
    group, x, y, last = substring.segments(np.array([0, 5, 10, 300]), np.array([100, 105, 111, 90]))
    assert (x.tolist(), y.tolist(), last.tolist()) == ([0, 10, 300], [100, 111, 90], [5, 10, 300])
    assert substring.chains(x.tolist(), y.tolist(), last.tolist()) == [[0, 1], [2]]


def longest_common(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if v == w else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_alignment_between_segments_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 15))
        same = rng.integers(10, 1000, 20)
        i, j = substring.aligned(np.concatenate([a, same, a]), np.concatenate([b, same, b]), [(len(a), len(b), 20)])
        assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all() and len(i) == 20 + 2 * longest_common(a, b)


def spread(tag, n):
    """Words that come nowhere else."""
    return [f"{tag}{k}" for k in range(n)]


def caught(spark, texts):
    """Of each text, by place: the words that are found again."""
    df = spark.createDataFrame([(k, " ".join(w), *REST) for k, w in enumerate(texts)], SCHEMA).coalesce(1)
    out = [set() for _ in texts]
    for r in substring.passages(df).collect():
        assert r.stop - r.start >= substring.LEAST and r.agreeing >= substring.SAME * max(r.stop - r.start, r.of_stop - r.of_start)
        out[r.doc_id].update(range(r.start, r.stop))
    return out


def test_a_chain_that_fails_is_split(spark):
    a, b, line = spread("a", 60), spread("b", 60), spread("l", 20)
    got = caught(spark, [
        [*a, *spread("c", 40), *line], [*a, *spread("d", 40), *line],
        [*b, *spread("e", 40), *spread("f", 60)], [*b, *spread("g", 40), *spread("f", 60)],
    ])
    assert got == [set(), set(range(60)), set(), {*range(60), *range(100, 160)}]


def test_passages_whose_seeds_come_first_elsewhere(spark):
    p, q, r = spread("p", 80), spread("q", 30), spread("r", 30)
    texts = [p[:45], p[35:], [*q, *spread("s", 9)], [*r, *spread("t", 9)], p, [*spread("u", 7), *p], [*q, *r], [*spread("v", 5), *q, *r], [*p, *spread("z", 3)]]
    assert caught(spark, texts) == by_runs(texts)


def by_runs(texts):
    """Of each text: the places in a run of LEAST words that comes before, by brute force."""
    seen, out = set(), []
    for w in texts:
        runs = [tuple(w[k : k + substring.LEAST]) for k in range(len(w) - substring.LEAST + 1)]
        out.append({k + j for k, run in enumerate(runs) if run in seen for j in range(substring.LEAST)})
        seen.update(runs)
    return out


def best_chains(x, y, last):
    """The best score of a chain that ends in each segment, by all pairs."""
    tail = [b + e - a for a, b, e in zip(x, y, last)]
    score = {}
    for k in sorted(range(len(x)), key=lambda j: x[j]):
        steps = [score[j] - substring.GAP_COST * (x[k] - last[j] + y[k] - tail[j]) for j in score if 0 < x[k] - last[j] <= substring.GAP and 0 < y[k] - tail[j] <= substring.GAP]
        score[k] = last[k] - x[k] + substring.SEED + max([0.0, *steps])
    return score


def test_chains_are_the_best_within_the_limits():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x, y = np.sort(rng.choice(400, 60, False)), rng.choice(400, 60, False)
        x, y = np.append(x, np.arange(500, 800, 8)), np.append(y, np.arange(500, 800, 8))  # and a long one, out of whose reach are others
        x, y = np.append(x, 880 + np.arange(0, 70, 9)), np.append(y, 881 + np.arange(0, 70, 9))
        _, x, y, last = (c.tolist() for c in substring.segments(x, y))
        best = best_chains(x, y, last)
        got = substring.chains(x, y, last)
        assert sorted(k for path in got for k in path) == list(range(len(x)))
        tail = [b + e - a for a, b, e in zip(x, y, last)]
        for path in got:
            for p, q in zip(path, path[1:]):
                assert 0 < x[q] - last[p] <= substring.GAP and 0 < y[q] - tail[p] <= substring.GAP
                assert best[q] == pytest.approx(best[p] + last[q] - x[q] + substring.SEED - substring.GAP_COST * (x[q] - last[p] + y[q] - tail[p]))
        assert best[got[0][-1]] == pytest.approx(max(best.values()))


def test_a_fuzzy_passage_after_a_long_one(spark):
    a, b, c = spread("a", 300), spread("b", 35), spread("c", 35)
    texts = [[*a, *spread("d", 80), *b, *spread("e", 5), *c], [*a, *spread("f", 80), *b, *spread("g", 5), *c]]
    assert caught(spark, texts) == [set(), {*range(300), *range(380, 455)}]


def test_hot_seeds(spark):
    """A passage of more documents than FEW, which come in one chunk; copies with changes; and a line over and over between."""
    rng, p = random.Random(2), spread("p", 60)
    texts = [[*spread(f"a{k}x", k % 7 + 3), *p, *spread(f"b{k}x", 5)] for k in range(40)]
    texts += [[w if rng.random() > 0.08 else f"new{k}x{n}" for n, w in enumerate(spread("q", 200))] for k in range(30)]
    got = caught(spark, texts)
    assert got[0] == set() and all(g >= set(range(k % 7 + 3, k % 7 + 63)) for k, g in list(enumerate(got))[1:40])
    assert all(len(g) > 150 for g in got[41:])


def test_periodic_texts(spark):
    line, again = spread("l", 30), ["again"] * 5000
    got = caught(spark, [line * 100, line * 100, again, again])
    # a passage of 50 words ends before it comes again in its own document, so from the third line on
    assert got == [set(range(60, 3000)), set(range(3000)), set(range(50, 5000)), set(range(5000))]


def test_seeds_of_changed_passages():
    """Of passages of 60 words with every fifth changed at random, nearly all share a seed."""
    rng, n = np.random.default_rng(7), 0
    words = lambda k: rng.integers(0, 1 << 60, k).astype(np.uint64)
    for _ in range(300):
        a = words(60)
        b = np.where(rng.random(60) < 0.2, words(60), a)
        x, y = (set(substring.seeds(np.concatenate([words(40), side, words(40)]))[1].tolist()) for side in (a, b))
        n += bool(x & y)
    assert n > 0.93 * 300


def test_short_texts_that_share_half_a_hash(spark):
    texts = [f"word{k}" for k in range(400_000)]
    half = mix(words_of(texts)[0]) >> np.uint64(32)  # a text of one word is one n-gram
    assert half[7] == grams(word_hashes(texts[7]), 5)[0] >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    at = np.flatnonzero(np.diff(half[order]) == 0)[:3]
    rows = [(k, texts[order[j]]) for k, j in enumerate(np.concatenate([at, at + 1]).tolist())]
    assert len(rows) == 6
    got = ngram_join.classes(spark.createDataFrame([(k, t, *REST) for k, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in got) == [(k, k, 0, True) for k in range(6)]


def test_sketches_of_similar_sets():
    rng = np.random.default_rng(3)
    apart = []
    for n in (40, 400):
        for _ in range(150):
            both, one, two = (rng.integers(0, 1 << 32, k, np.uint64) for k in (8 * n, n, n))
            a, b = (ngram_join.sketch(ngram_join.signature(np.unique(np.concatenate([both, x])).astype(np.uint32), ngram_join.TREES * ngram_join.DEPTH)) for x in (one, two))
            apart.append(sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b)))
    assert max(apart) < ngram_join.near_bits() and 60 < np.mean(apart) < 95
    far = [ngram_join.sketch(ngram_join.signature(rng.integers(0, 1 << 32, 300, np.uint64).astype(np.uint32), ngram_join.TREES * ngram_join.DEPTH)) for _ in range(40)]
    assert min(sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b)) for a, b in zip(far, far[1:])) > 2 * ngram_join.near_bits()


@pytest.mark.parametrize("changed, least", [(0.1, 0.99), (0.15, 0.97), (0.2, 0.9)])
def test_recall_of_fuzzy_passages(spark, changed, least):
    """Of pairs of texts with a passage of 60 words, some changed at random, that agree by SAME: those whose passage is found."""
    rng, texts, held = random.Random(9), [], []
    for k in range(150):
        p = spread(f"p{k}x", 60)
        q = [w if rng.random() >= changed else f"new{k}x{n}" for n, w in enumerate(p)]
        if sum(a == b for a, b in zip(p, q)) >= substring.SAME * 60:
            held.append(len(texts) + 1)
            texts += [[*spread(f"a{k}x", rng.randrange(40)), *p, *spread(f"b{k}x", rng.randrange(40))], [*spread(f"c{k}x", rng.randrange(40)), *q, *spread(f"d{k}x", rng.randrange(40))]]
    got = caught(spark, texts)
    assert len(held) > 60 and np.mean([len(got[k]) >= substring.LEAST for k in held]) >= least
