"""Mixing, packing, sharding, chats, quality, URLs and token counts: edge cases,
and brute force where SQL has no counterpart."""

import base64
import hashlib
import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import chat, common, mixing, packing, quality, sharding, token_counts, url_rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, start long, key string"
EDGES = [
    (1, "a b c", "x", 1, "k"),
    (1, "a b c", "x", 1, "k"),
    (2, None, "x", None, None),
    (3, "", None, 0, ""),
    (None, "n n", None, 0, ""),
    (None, None, None, None, None),
    (4, "w " * 5000, "y", 0, ""),
    (5, "one", "y", 0, ""),
    (6, "", "empty", 0, ""),
]


def tokens(t):
    return len((t or "").split())


def brute_mix(rows, weights, default, budget, seed):
    """Takes documents one by one, in key order, epoch after epoch."""
    by = defaultdict(list)
    for i, t, s in rows:
        who = str(i) if i is not None else "null:" + (t or "")
        by[s].append((hashlib.md5(f"{seed}|{who}".encode()).hexdigest(), tokens(t), i))
    total = {s: sum(x[1] for x in v) for s, v in by.items()}
    w = {s: weights.get(s, default) if total[s] else 0.0 for s in by}
    out = Counter()
    for s, v in by.items():
        if not total[s]:
            continue
        left = int((sum(total.values()) if budget is None else budget) * (w[s] / sum(w.values())))
        epoch = 1
        while left > 0:
            taken = None
            for k, n, i in sorted(v, key=lambda x: x[:2]):
                if left <= 0 and k != taken:
                    break
                taken = k
                out[i, s, epoch, n, min(n, max(left, 0))] += 1
                left -= n
            left, epoch = max(left, 0), epoch + 1
    return out


@pytest.mark.parametrize("weights,budget", [({"x": 3.0}, None), ({"x": 5.0, "y": 0.001}, 20001), ({}, 40), ({}, 0)])
def test_mix_edges(spark, weights, budget):
    df = spark.createDataFrame(EDGES, SCHEMA)
    got = Counter((r.doc_id, r.source, r.epoch, r.tokens, r.used) for r in mixing.mix_plan(df, weights, 1.0, budget).collect())
    want = brute_mix([r[:3] for r in EDGES], weights, 1.0, budget, mixing.SEED)
    # documents without tokens that lie beyond the cut make no difference
    assert {k: v for k, v in got.items() if k[3]} == {k: v for k, v in want.items() if k[3]}
    whole = mixing.mix(df, weights, 1.0, budget)
    assert whole.columns == df.columns
    assert Counter(r.doc_id for r in whole.collect()) == Counter(x for k, v in got.items() for x in [k[0]] * v)


def test_mix_counts_given_tokens(spark):
    rows = [(i, "w " * (i % 3), f"s{i % 2}", 7 * i % 11) for i in range(40)] + [(40, "a b", "s0", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = Counter((r.doc_id, r.source, r.epoch, r.tokens, r.used) for r in mixing.mix_plan(df, {"s0": 3.0}, tokens=F.col("n")).collect())
    assert got == brute_mix([(i, "w " * (n or 0), s) for i, _, s, n in rows], {"s0": 3.0}, 1.0, None, mixing.SEED)
    whole = Counter(r.doc_id for r in mixing.mix(df, {"s0": 3.0}, tokens=F.col("n")).collect())
    assert whole == Counter(x[0] for x in got.elements())


def test_mix_budgets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = Counter((r.doc_id, r.source, r.epoch, r.tokens, r.used) for r in mixing.mix_plan(docs, {"src0": 4.0}).collect())
    assert got == brute_mix(rows, {"src0": 4.0}, 1.0, None, mixing.SEED)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def brute_pack(lengths, most):
    """Longest first, each into the pack with the most room left."""
    packs = []
    for n in sorted(lengths, reverse=True):
        best = max((p for p in packs if most - sum(p) >= n), key=lambda p: most - sum(p), default=None)
        if best is None:
            packs.append(best := [])
        best.append(n)
    return Counter(tuple(sorted(p)) for p in packs)


def test_place_is_shortest_pack_first():
    random.seed(3)
    for _ in range(30):
        most = random.choice([8, 20, 64])
        lengths = [random.randint(1, most) for _ in range(random.randint(1, 120))]
        placed = packing.place(Counter(lengths), most)
        packs, ranks = defaultdict(list), defaultdict(list)
        for n, r, k, p, o in placed:
            for i in range(k):
                packs[p + i].append((o, n))
                ranks[n].append(r + i)
        assert all(sorted(v) == list(range(Counter(lengths)[n])) for n, v in ranks.items())
        for p in packs.values():
            at = 0
            for o, n in sorted(p):
                assert o == at
                at += n
            assert at <= most
        want = brute_pack(lengths, most)
        assert sum(want.values()) == len(packs)
        assert sorted(sum(n for _, n in p) for p in packs.values()) == sorted(sum(k) for k in want.elements())


@pytest.mark.parametrize("bucket", [3, 200_000])
def test_pack_places_every_token_once(spark, monkeypatch, bucket):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", bucket)
    docs = spark.createDataFrame(EDGES, SCHEMA).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "source", F.lit(0).alias("start"), F.lit("").alias("key")))
    rows = packing.pack(docs, 512).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append((r.start, r.length))
        assert r.start == r.piece * 512 and 0 < r.length <= 512
    want = defaultdict(list)
    for i, t, *_ in docs.collect():
        n = tokens(t) + 1
        want[i] += [(s, min(512, n - s)) for s in range(0, n, 512)]
    assert {k: sorted(v) for k, v in of.items()} == {k: sorted(v) for k, v in want.items()}
    packs = defaultdict(list)
    for r in rows:
        packs[r.pack].append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    for p in packs.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 512
    lengths = [n for v in want.values() for _, n in v]
    assert sum(brute_pack(lengths, 512).values()) == len(packs)
    assert packing.pack(docs.limit(0)).count() == 0


def brute_deal(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    out = defaultdict(Counter)
    for s in sorted((s for s, n in sizes for _ in range(n)), reverse=True):
        x, i = heapq.heappop(heap)
        out[s][i] += 1
        heapq.heappush(heap, (x + s, i))
    return out


def test_deal_is_the_heap():
    random.seed(5)
    for _ in range(40):
        shards = random.choice([1, 3, 8])
        sizes = [(s, random.choice([1, 2, 5, 200])) for s in random.sample(range(0, 50), random.randint(1, 8))]
        got = defaultdict(Counter)
        for s, a, b, i in zip(*sharding.deal(sizes, shards)):
            got[s][i] += b - a
        assert got == brute_deal(sizes, shards)


def test_shard(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    rows = sharding.shard(df, F.col("source"), 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in EDGES)
    at = {r.doc_id: r.shard for r in rows if r.doc_id is not None}
    assert at[1] == at[2] and at[4] == at[5] and len({at[1], at[4]}) == 2
    assert sharding.shard(df.limit(0), F.col("source")).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    load = Counter()
    for r in sharding.shard(docs, F.md5("text"), 4).join(docs, "doc_id").collect():
        load[r.shard] += len(r.text) + 1
    sizes = Counter()
    for r in docs.collect():
        sizes[r.text] += len(r.text) + 1
    want = Counter()
    for s, c in brute_deal(list(Counter(sizes.values()).items()), 4).items():
        for i, n in c.items():
            want[i] += s * n
    assert load == want


def test_chats(spark):
    turns = [(1, 2, "b", "two"), (1, 1, "a", "é\nx"), (1, 2, "a", ""), (1, 2, "b", "two"), (None, None, None, None), (None, 1, "u", "n"), (2, None, None, "z" * 100000), (3, 0, "r" * 3, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    want = defaultdict(list)
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, t, r, x in sorted(turns, key=lambda v: (low(v[1]), v[2] is not None, v[2] or "", v[3] is not None, v[3] or "")):
        want[c].append(f"<|im_start|>{'user' if r is None else r}\n{x or ''}<|im_end|>\n")
    got = {r.conv_id: (r.turns, r.text) for r in chat.format_chats(df).collect()}
    assert got == {c: (len(v), "".join(v)) for c, v in want.items()}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_over_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat, "BYTES", 1)
    t = pa.table({"conv_id": pa.array([1, 1, 1, 2, 3, 3]), "role": ["a", "b", None, "c", "d", "e"], "text": ["1", "22", None, "4", "5", "6"]})
    whole = [r for b in chat._format(t.to_batches()) for r in b.to_pylist()]
    for n in (1, 2, 4):
        assert [r for b in chat._format(t.to_batches(n)) for r in b.to_pylist()] == whole
    assert [r["turns"] for r in whole] == [3, 1, 2]


def test_quality(spark):
    good = "the old cat and the young dog lived in a small house near the wood, where every evening somebody lit the lamp for them"
    rows = [(1, good), (2, None), (3, ""), (4, " \n"), (5, "SHOUTING ALL THE TIME AGAIN!!"), (6, "word " * 40), (7, "a### b%%% c$$$"), (8, "Hi."), (9, (good + "\n") * 3000), (1, good)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(1)).withColumn("words", F.lit(2))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 8])
    by = {r.doc_id: r.rejected_by for r in quality.judged(df).collect()}
    assert by[2] == by[3] == by[4] == "empty" and by[7] == "symbols" and by[9] == "few_distinct_words" and by[8] is None
    assert quality.keep_good(df.limit(0)).count() == 0


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    good = [(r.doc_id, r.quality) for r in docs.collect()]
    assert sum(i in kept for i, q in good if q) >= 0.99 * sum(q for _, q in good)
    assert sum(i not in kept for i, q in good if not q) >= 0.85 * sum(1 - q for _, q in good)


def test_stop_words_expression():
    import re

    exp = re.compile(quality.any_of(quality.STOP_WORDS))
    assert all(exp.fullmatch(w) for w in quality.STOP_WORDS)
    assert not any(exp.fullmatch(w) for w in ("t", "thee", "", "wi", "verb"))


def brute_rules(rows, support, confidence, lift):
    """All token sets of the bad rows, counted one by one."""
    from itertools import combinations

    n, bad = len(rows), [t for t, b in rows if b]
    sets = {frozenset(c) for t in bad for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    out = {}
    for s in sets:
        b, a = sum(s <= t for t in bad), sum(s <= t for t, _ in rows)
        if b >= support * n and b / a >= max(confidence, lift * len(bad) / n):
            out[s] = b / a
    return {s: c for s, c in out.items() if not any(o < s and out[o] >= c for o in out)}


def test_url_rules(spark):
    random.seed(2)
    rows = []
    for i in range(400):
        host = random.choice(["m.spam.example.com", "www.good.example.org", "blog.fine.example.net", "spam.example.org"])
        url = f"http{random.choice(['', 's'])}://{host}/{random.choice(['en', 'de'])}/{i}{random.choice(['', '?page=2', '.html', '#top', '/'])}"
        rows.append((i, url, random.random() < (0.8 if "spam" in host and "en" in url else 0.1)))
    rows += [(400, None, True), (401, "not a url", False), (402, rows[0][1], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean").withColumn("rule", F.lit(1))
    toks = {r.page_id: r.t for r in df.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    assert toks[401] == ["other"] and toks[400] is None
    rules = url_rules.mine(df, min_support=0.02)
    got = {frozenset(r.tokens): r.confidence for r in rules.df.collect()}
    want = brute_rules([(set(toks[i]), b) for i, u, b in rows if u is not None and b is not None], 0.02, url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT)
    assert got == pytest.approx(want) and any("name=spam" in s for s in got)
    fired = {r.page_id: (r.rules, r.confidence) for r in url_rules.filter_urls(df, rules.df).collect()}
    for i, t in toks.items():
        own = [c for s, c in got.items() if t and s <= set(t)]
        assert fired.get(i) == ((len(own), pytest.approx(max(own), abs=1e-6)) if own else None)
    assert url_rules.filter_urls(df.limit(0), rules.df).count() == 0
    assert url_rules.mine(df.limit(0)).df.count() == 0
    assert url_rules.mine(df.where("not bad")).df.count() == 0


def test_url_rules_are_of_all_rows(spark):
    """The number of rows that FP-growth gets doesn't change the rules."""
    random.seed(5)
    rows = []
    for _ in range(1500):
        k = random.randrange(60)
        url = f"http://h{k}.example.org/{random.choice(['en', 'de', 'fr'])}/{random.randrange(10**6)}{random.choice(['', '.html', '?page=2', '/'])}"
        rows.append((url, random.random() < (0.7 if k < 12 else 0.1)))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    toks = [r.t for r in df.select(url_rules.url_tokens(F.col("url")).alias("t")).collect()]
    want = brute_rules([(set(t), b) for t, (_, b) in zip(toks, rows)], 0.004, url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT)
    assert len(want) >= 12
    for fit_rows in (url_rules.FIT_ROWS, 200, 20):
        got = {frozenset(r.tokens): (r.confidence, r.support) for r in url_rules.mine(df, min_support=0.004, fit_rows=fit_rows).df.collect()}
        assert {s: c for s, (c, _) in got.items()} == pytest.approx(want)
        assert all(x == pytest.approx(sum(b and s <= set(t) for t, (_, b) in zip(toks, rows)) / len(rows)) for s, (_, x) in got.items())


def test_labels_join_pages_by_the_number_in_the_url(spark):
    pages = spark.createDataFrame([(9, "http://a.b/en/1?x=3"), (8, "http://a.b/en/2.html"), (7, "http://a.b/"), (6, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (None, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.url: r.bad for r in url_rules.label_pages(pages, labels).collect()} == {"http://a.b/en/1?x=3": True, "http://a.b/en/2.html": False}


def test_token_counts_at_every_prefix(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    with open(token_counts.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    texts = ["don't we'll 'll 'so ''s a's's 'l", "a  b   c\n\nd \n e\t\tf  ", "", None, "x y 　z", "!!'s '' 've", "日本語 123abc ½²", "\U0001f600\U0001f600 ok", "<|endoftext|>", " \n ", "A" * 700]
    texts += ["".join(random.choice("ab'slvreè 1 \n\t.,!日\U0001f600") for _ in range(random.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit(0))
    out = token_counts.prefix_counts(df, budget=5)
    asked = [(f"at{k}", token_counts.count_at(F.col("counts"), F.lit(k))) for k in (-1, 0, 1, 9, 10**6)] + [(f"in{k}", token_counts.longest_within(F.col("counts"), F.lit(k))) for k in (0, 1, 9)]
    out = out.withColumns(dict(asked)).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id]
        if t is None:
            assert (r.tokens, r.counts, r.fits, r.at9, r.in9) == (0, None, 0, None, None)
            continue
        want = [len(enc.encode_ordinary(t[:i])) for i in range(len(t) + 1)]
        assert np.frombuffer(r.counts, ">i4").tolist() == want[1:]
        assert r.tokens == want[-1]
        assert all(r[f"at{k}"] == want[min(max(k, 0), len(t))] for k in (-1, 0, 1, 9, 10**6))
        assert r.fits == max(i for i, n in enumerate(want) if n <= 5)
        assert all(r[f"in{k}"] == max(i for i, n in enumerate(want) if n <= k) for k in (0, 1, 9))
    assert token_counts.prefix_counts(df.limit(0)).count() == 0
    counted, name = token_counts.token_count(df.withColumn("n_tokens", F.lit(7)))
    assert name == "_n_tokens" and {r.doc_id: r[name] for r in counted.collect()} == {r.doc_id: r.tokens for r in out}


def test_very_long_text_and_forgetting(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    a = {r.doc_id: bytes(r.counts) for r in token_counts.prefix_counts(docs).collect()}
    c = token_counts.Counter(token_counts.default_vocabulary())
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    for r in docs.collect():
        n, _ = c.counts(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        assert n.astype(">i4").tobytes() == a[r.doc_id]


def test_a_text_of_millions_of_characters_is_counted_whole(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    with open(token_counts.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    text = "\n\n".join(r.text for r in docs)
    text = text * (3_000_000 // len(text) + 1)
    df = spark.createDataFrame([("x/1", text), ("x/2", "short")], "doc_id string, text string")
    r = {x.doc_id: x for x in token_counts.prefix_counts(df, budget=500_000).collect()}
    assert r["x/1"].tokens == len(enc.encode_ordinary(text)) and r["x/2"].tokens == len(enc.encode_ordinary("short"))
    c = np.frombuffer(r["x/1"].counts, ">i4")
    assert len(c) == len(text) and r["x/1"].fits == np.flatnonzero(c <= 500_000)[-1] + 1
    for k in (7, 123_456, 2_999_999):
        assert c[k - 1] == len(enc.encode_ordinary(text[:k]))


def test_string_ids_and_clashing_columns(spark):
    """Ids of text, columns with the names that the operators use."""
    rows = [(f"https://a.b/{i}", "w " * (i % 4) + "x" * (i % 3), f"s{i % 2}") for i in range(30)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    for c in ("key", "length", "pack", "piece", "shard", "group", "size", "rank", "s", "g", "tokens", "epoch", "used", "conv_id", "turns"):
        df = df.withColumn(c, F.lit("clash"))
    got = Counter((r.doc_id, r.source, r.epoch, r.tokens, r.used) for r in mixing.mix_plan(df, {"s0": 2.0}).collect())
    want = brute_mix([r[:3] for r in rows], {"s0": 2.0}, 1.0, None, mixing.SEED)
    assert {k: v for k, v in got.items() if k[3]} == {k: v for k, v in want.items() if k[3]}
    assert mixing.mix(df, {"s0": 2.0}).columns == df.columns
    assert Counter(r.doc_id for r in packing.pack(df, 64).collect()) == Counter(r[0] for r in rows)
    shards = {r.doc_id: r.shard for r in sharding.shard(df, F.col("source"), 3).collect()}
    assert set(shards) == {r[0] for r in rows} and len({(s, shards[i]) for i, _, s in rows}) == 3
    turns = spark.createDataFrame([("a-1", 1, "u", "one"), ("b", 1, "u", "x"), ("a-1", 2, "v", "two"), (None, 1, "u", "n"), (None, 0, "u", "m")], "conv_id string, turn long, role string, text string").withColumn("turns", F.lit(0))
    got = {r.conv_id: (r.turns, r.text.count("<|im_start|>")) for r in chat.format_chats(turns).collect()}
    assert got == {"a-1": (2, 2), "b": (1, 1), None: (2, 2)}


def test_very_long_urls(spark):
    url = "http://h.example.org/" + "dir/" * 50_000 + "1?" + "&".join(f"k{i}=1" for i in range(2000))
    rows = [(url, True)] * 30 + [("http://good.example.org/2", False)] * 30
    df = spark.createDataFrame(rows, "url string, bad boolean").withColumn("page_id", F.lit("p-1")).withColumn("tokens", F.lit(1))
    toks = df.select(F.size(url_rules.url_tokens(F.col("url"))).alias("n")).collect()
    assert {r.n for r in toks} == {2000 + 6, 5}
    rules = spark.createDataFrame([(1, ["key=k1999", "dir=dir"], 0.5, 1.0)], "rule long, tokens array<string>, support double, confidence double")
    assert Counter(r.page_id for r in url_rules.filter_urls(df, rules).collect()) == {"p-1": 30}


def test_shared_dir_is_the_session_s(spark):
    class Conf:
        def get(self, k, d=None):
            return d

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert common.shared_dir(spark) == conf if conf else common.shared_dir(spark).startswith("file:")
