"""Exact, near and line dedup against brute force, and their edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import common, exact_dedup, line_dedup, near_dedup
from pixelloom.llm.texts import fold, utf8, words

SF = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, "one two three four five", "en", "a", 5),
    (1, "one two three four five", "en", "a", 5),
    (2, "one two three four five", "en", "a", 5),
    (None, "one two three four five", None, None, None),
    (3, None, "en", "a", 0),
    (4, None, "en", "b", 0),
    (5, "", "en", "a", 0),
    (6, "", None, "a", 0),
    (7, " \n\t", "en", "a", 3),
    (8, "alone " * 20000, "en", "a", 120000),
    (9, "x" * 300000, "en", "a", 300000),
    (None, None, None, None, None),
]


def split(t):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", fold(np.frombuffer(t.encode(), np.uint8)).tobytes().decode()) if w]


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["The cat, the CAT; Été été", "", "cat", "the", "a" * 100 + " the"]
    data, off = utf8(pa.array(texts))
    w, at = words(data, off)
    got = [[int(x) for x in w[at[i] : at[i + 1]]] for i in range(len(texts))]
    assert [len(g) for g in got] == [6, 0, 1, 1, 2]
    assert got[0][0] == got[0][2] == got[3][0] == got[4][1] and got[0][1] == got[0][3] == got[2][0] and got[0][4] == got[0][5]
    assert len({*got[0], *got[4]}) == 4


def test_exact_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    kept = exact_dedup.exact_dedup(df, salts=3)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    texts = {t for _, t, *_ in EDGES}
    assert len(rows) == len(texts)
    assert Counter(i for i, t in rows if t is None or t == "" or t.startswith("one")) == Counter({1: 1, 3: 1, 5: 1})
    ids = [r.doc_id for r in exact_dedup.exact_winners(df).collect()]
    assert sorted(ids) == sorted(i for i, _ in rows)
    empty = df.limit(0)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.exact_winners(empty).count() == 0


def test_exact_clashing_columns_and_maps(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, {"k": 1}), (1, "a", 1, 1, {"k": 0}), (2, "b", None, 0, None)], "doc_id long, text string, digest int, first int, rank map<string,int>")
    rows = exact_dedup.exact_dedup(df)
    assert rows.columns == df.columns and sorted(r.first for r in rows.collect()) == [0, 1]


def test_any_salts_agree_and_strings_are_ids(spark):
    docs = spark.read.parquet(SF).repartition(5)
    a = {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()}
    assert a == {tuple(r) for r in exact_dedup.exact_dedup(docs, salts=1).collect()}
    plan = exact_dedup.exact_winners(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" in plan and "salt" in plan
    named = docs.withColumn("doc_id", F.concat(F.lit("u-"), "doc_id"))
    got = {r.doc_id for r in exact_dedup.exact_winners(named).collect()}
    want = {}
    for r in named.collect():
        want[r.text] = min(want.get(r.text, r.doc_id), r.doc_id)
    assert got == set(want.values())


def test_prefix_counts_of_the_forest():
    tree = np.zeros(6, int)
    key = np.array([[0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 2], [0, 0, 9, 2], [5, 0, 0, 0], [5, 0, 0, 0]], ">u4")
    low = np.zeros((6, 128), np.uint8)
    low[3] = 1
    root = near_dedup.linked(tree, np.ascontiguousarray(key).view(np.uint8), low, 0.5, 2, 2)
    assert root.tolist() == [0, 0, 0, 3, 4, 4]


def test_large_regions_are_compared_with_leaders():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 256, (3, 128)).astype(np.uint8)
    which = rng.integers(0, 3, 500)
    low = kinds[which]
    key = np.zeros((500, 32), np.uint8)
    root = near_dedup.linked(np.zeros(500, int), key, low, 0.5, 2, 16)
    assert len({(a, b) for a, b in zip(which, root)}) == 3 == len(set(root))


def test_pairs_among_thousands_that_share_a_passage():
    """Pairs of J 0.6 among documents that all share two thirds of their trigrams;
    low bytes tell the pairs apart, so that only pairs which were compared link."""
    rng, pairs = np.random.default_rng(0), 2000
    parts = [np.broadcast_to(rng.integers(0, 2**32, 200, dtype=np.uint32), (2 * pairs, 200))]
    parts += [np.repeat(rng.integers(0, 2**32, (pairs, 25), dtype=np.uint32), 2, axis=0), rng.integers(0, 2**32, (2 * pairs, 75), dtype=np.uint32)]
    sig = near_dedup.minima(np.concatenate(parts, axis=1).reshape(-1), np.arange(2 * pairs + 1) * 300, near_dedup.HASHES)
    low = np.repeat(rng.integers(0, 256, (pairs, near_dedup.HASHES)).astype(np.uint8), 2, axis=0)
    links, some = near_dedup.Links(2 * pairs), np.arange(2 * pairs)
    for again in (False, True):
        left = np.zeros(2 * pairs, bool)
        for t in range(near_dedup.TREES):
            k = sig[some][:, near_dedup.minima_of(t, near_dedup.TREES, near_dedup.DEPTH, near_dedup.HASHES, again)]
            o = np.lexsort(k.T[::-1])
            key, tree = np.ascontiguousarray(k[o].astype(">u4")).view(np.uint8), np.zeros(len(o), int)
            r = near_dedup.linked(tree, key, low[some[o]], near_dedup.THRESHOLD, near_dedup.MIN_DEPTH, near_dedup.REGION)
            links.add(some[o], some[o[r]])
            left[some[o[near_dedup.unsettled(tree, key, r, near_dedup.MIN_DEPTH, near_dedup.REGION)]]] = True
        some = np.flatnonzero(left)
    root = links.roots()
    found = np.mean(root[::2] == root[1::2])
    print("compared:", found)
    assert found >= 0.95


def brute_pairs(rows, n=3):
    grams, where = {}, defaultdict(set)
    for i, t in rows:
        w = split(t or "")
        if w:
            grams[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
            for g in grams[i]:
                where[g].add(i)
    common = Counter((a, b) for s in where.values() if len(s) > 1 for a in s for b in s if a < b)
    return {(a, b): c / (len(grams[a]) + len(grams[b]) - c) for (a, b), c in common.items()}


def test_near_recall_and_precision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = defaultdict(set)
    for r in near_dedup.near_groups(docs).collect():
        groups[r.kept_doc_id].add(r.doc_id)
    of = {i: k for k, s in groups.items() for i in s}
    sim = brute_pairs([(r.doc_id, r.text) for r in docs.collect()])
    near = [p for p, j in sim.items() if j >= 0.6]
    assert len(near) > 100
    assert sum(of.get(a) is not None and of.get(a) == of.get(b) for a, b in near) >= 0.98 * len(near)
    partners = {i for (a, b), j in sim.items() if j >= 0.45 for i in (a, b)}
    assert not set(of) - partners


def test_near_edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    pairs = sorted((r.doc_id is None, r.doc_id, r.kept_doc_id) for r in near_dedup.near_pairs(df).collect())
    assert pairs == [(False, 1, 1), (False, 2, 1), (True, None, 1)]
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, 9, None])
    assert near_dedup.near_dedup(df.limit(0)).count() == 0


def all_pairs(low, need):
    """Groups of all pairs that match, by their first member."""
    root = list(range(len(low)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(low)):
        for j in np.flatnonzero((low[i + 1 :] == low[i]).sum(axis=1) >= need) + i + 1:
            a, b = sorted((of(i), of(int(j))))
            root[b] = a
    return [of(i) for i in range(len(low))]


@pytest.mark.parametrize("n", [63, 64, 65, 66, 100, 300])
def test_regions_of_full_depth_are_compared_pair_by_pair(n):
    """Chains: each matches the next but one that is shuffled somewhere, and fillers."""
    rng = np.random.default_rng(n)
    low = rng.integers(0, 256, (n, 128)).astype(np.uint8)
    for i in range(1, 40):
        low[i] = low[i - 1]
        low[i, rng.permutation(128)[:50]] = rng.integers(0, 256, 50)
    low = low[rng.permutation(n)]
    key = np.zeros((n, 32), np.uint8)
    want = all_pairs(low, near_dedup.least_equal(128, 0.55))
    assert near_dedup.linked(np.zeros(n, int), key, low, 0.55, 2, 64).tolist() == want
    assert len(set(want)) == n - 39


def test_pieces_of_the_orders_give_what_the_whole_gives():
    """However few entries are taken up at a time."""
    rng = np.random.default_rng(4)
    n = 3000
    minima = rng.integers(0, 3, (n, 8)).astype(">u4")
    minima[:900] = minima[0]
    minima[900:1800, :3] = 7
    tree = rng.integers(0, 2, n).astype(np.int32)
    low = rng.integers(0, 256, (12, 128)).astype(np.uint8)[rng.integers(0, 12, n)]
    o = np.lexsort((*minima.T[::-1], tree))
    tree, key, low = tree[o], np.ascontiguousarray(minima[o]).view(np.uint8).reshape(n, 32), low[o]
    t = pa.table({"tree": tree, "key": near_dedup.fixed(key), "node": np.arange(n), "low": near_dedup.fixed(low)})

    def groups(most, rows):
        edges = [(r["u"], r["v"]) for b in near_dedup._link(iter(t.to_batches(rows)), 0.5, 2, 16, most) for r in b.to_pylist() if r["kind"] == 0]
        links = near_dedup.Links(n)
        links.add(np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
        return links.roots().tolist()

    whole = groups(10**9, n)
    assert whole == near_dedup.linked(tree, key, low, 0.5, 2, 16).tolist()
    for most, rows in ((1500, 100), (400, 70), (200, 200)):
        assert groups(most, rows) == whole


def test_near_pairs_are_the_same_with_any_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = Counter(map(tuple, near_dedup.near_pairs(docs).collect()))
    monkeypatch.setattr(near_dedup, "ENTRIES", 700)
    assert Counter(map(tuple, near_dedup.near_pairs(docs.repartition(7)).collect())) == want and want


def test_near_with_ids_of_text(spark):
    text = "it was a dark night and nobody saw the small boat leave the harbour"
    rows = [("u/3", text), ("u/1", text + " again"), (None, text), ("u/2", "something else that has nothing to do with it"), ("u/3", text), ("a-1", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    assert Counter(map(tuple, near_dedup.near_pairs(df).collect())) == Counter({("u/3", "u/1"): 2, (None, "u/1"): 1})
    assert Counter(r.doc_id for r in near_dedup.near_dedup(df).collect()) == Counter(["u/1", "u/2", "a-1"])


def test_near_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6), (2, "a b c d e", 5, 6), (3, "x y z", None, 1)], "doc_id long, text string, node int, near_h int")
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (10, 9), (7, 7)]
    got = {(r.u, r.v) for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).df.collect()}
    assert got == {(5, 1), (4, 1), (3, 1), (2, 1), (9, 8), (10, 8)}


def brute_lines(rows, t):
    """(doc_id, line) of the lines that an earlier one matches."""
    seen, out, by = [], set(), {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(split(line))
            if not s:
                continue
            if s not in by:
                by[s] = any(len(s & o) >= t * len(s | o) - 1e-12 for o in seen if t * len(s) <= len(o) <= len(s) / t)
                if by[s]:
                    out.add((i, k))
                seen.append(s)
            else:
                out.add((i, k))
    return out


@pytest.mark.parametrize("t", [0.8, 0.6])
def test_lines_against_brute_force(spark, t):
    docs = spark.read.parquet(SF).repartition(3)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = line_dedup.line_matches(docs, t).collect()
    assert {(r.doc_id, r.line) for r in got} == brute_lines(rows, t)
    assert all((r.first_doc_id, r.first_line) < (r.doc_id, r.line) for r in got)


@pytest.mark.parametrize("t,settings", [(0.8, {"candidates": 1}), (0.6, {"candidates": 1, "hot": 0}), (0.5, {"hot": 5}), (0.8, {"hot": 3, "candidates": 2}), (0.8, {"hash_bits": 22})])
def test_lines_are_the_same_with_any_settings(spark, t, settings):
    """A second round for nearly all sets, pairs of frequent words as keys, and words
    of one hash change nothing, first matches included."""
    docs = spark.read.parquet(SF).where("doc_id < 120").repartition(3)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in line_dedup.line_matches(docs, t, **settings).collect()}
    assert got == earliest_lines(rows, t) and got


def earliest_lines(rows, t):
    """{(doc_id, line): the earliest line that matches it} of the lines that go."""
    seen, out, by = {}, {}, {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(split(line))
            if not s:
                continue
            if s not in by:
                by[s] = min((at for o, at in seen.items() if len(s & o) >= t * len(s | o) - 1e-12), default=None)
                seen[s] = (i, k)
            m = min(x for x in (by[s], seen[s]) if x is not None)
            if m != (i, k):
                out[i, k] = m
    return out


def test_words_of_one_hash_are_told_apart(spark):
    """The first two words have the same 40 bits; with 8 bits many have."""
    texts = ["w5cccf3b5f95", "wb67028d014f", "w5cccf3b5f95 wb67028d014f", "aa bb cc dd ee", "aa bb cc dd ff", "gg hh ii jj kk ll mm nn oo pp", "gg hh ii jj kk ll mm nn oo"]
    df = spark.createDataFrame([(f"http://x/{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    for bits in (8, 40, 58):
        assert {(r.doc_id, r.first_doc_id) for r in line_dedup.line_matches(df, hash_bits=bits).collect()} == {("http://x/6", "http://x/5")}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, hash_bits=10).collect()}
    assert out == {f"http://x/{i}": "" if i == 6 else t for i, t in enumerate(texts)}


def test_sets_that_the_first_candidates_do_not_settle(spark):
    """Hundreds of lines that miss the threshold by one word, so that some pass the
    filters of words' parities and fail: the second round finds what comes later."""
    rng = np.random.default_rng(3)
    base = [f"common{i}" for i in range(10)]
    lines = []
    for i in range(700):
        own = list(base)
        for k in rng.permutation(10)[: 1 if i >= 600 else 2]:
            own[k] = f"other{rng.integers(0, 400)}"
        lines.append(" ".join(own))
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = len(common._OPEN)
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in line_dedup.line_matches(df, candidates=1).collect()}
    assert got == earliest_lines(rows, 0.8)
    assert any("line-points" in t.path for t in common._OPEN[before:])


def test_lines_of_other_ids_and_sizes(spark):
    """Ids of text sort by their bytes, null ids last; sets of more than 255 and of
    more than 65,535 words; thousands of lines alike in one document."""
    long = [f"w{i}" for i in range(70_000)]
    many = "\n".join(f"alpha beta gamma delta epsilon zeta eta theta iota {i}" for i in range(400))
    rows = [("b", " ".join(long)), ("a", " ".join(long[500:])), ("c", " ".join(long[:300])), ("ca", " ".join(long[:300][::-1])), (None, " ".join(long[:290])), ("d", many), ("", "x"), ("a0", " ".join(long[300:600]))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in line_dedup.line_matches(df).collect()}
    assert got == {("b", 0): ("a", 0), ("ca", 0): ("c", 0), (None, 0): ("c", 0)} | {("d", k): ("d", 0) for k in range(1, 400)}


def test_line_edges(spark):
    text = "same words here\n\n!!!\nsame words here\nHERE same, words same"
    df = spark.createDataFrame([(2, text, 1), (1, "same words here", 2), (1, "same words here", 2), (None, "same words here", 3), (3, None, 4), (4, "", 5)], "doc_id long, text string, row int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter({(2, "\n!!!"): 1, (1, "same words here"): 1, (1, ""): 1, (None, ""): 1, (3, None): 1, (4, ""): 1})
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_prefix_length_covers_every_partner():
    for t in (0.6, 0.8, 0.9):
        for n in range(1, 40):
            p = int(line_dedup.prefix_length(np.array([n]), t)[0])
            partners = [m for m in range(1, 80) if m != n and min(m, n) / max(m, n) >= t - 1e-12]
            substitution = [n] if n and (n - 1) / (n + 1) >= t - 1e-12 else []
            if not partners and not substitution:
                assert p == 0
            else:
                assert p == n - int(np.ceil(t * n - 1e-9)) + 1
