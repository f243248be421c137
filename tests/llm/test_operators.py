"""The training-data operators against brute force, round trips and the libraries they must agree with."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import bpe, components, license_scan, ogg_media, quality, queries, sharding, simhash, tiling, token_count, url_rules, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Null, empty, white space, very long, repeated rows, ties.
ODD = [None, "", "   \n", "word", "word", "a b c d e f g h", "a b c d e f g h", "x" * 200_000, "lorem ipsum dolor " * 20_000, "Ünïcödé ß İ 漢字 🙂", "\x00\x1c\x85"]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, [0, 1, 2, 3, 3, 5, 6, 7, 8, None, 10])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Sharding.


def brute_best_fit(sizes, capacity):
    bins, where = [], {}
    for k, s in sorted(enumerate(sizes), key=lambda x: -x[1]):
        fits = [(r, b) for b, r in enumerate(bins) if r >= s]
        if fits:
            r, b = min(fits)
            bins[b] -= s
        else:
            b = len(bins)
            bins.append(max(capacity, s) - s)
        where[k] = b
    return bins, where


def test_best_fit_equals_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        counts = pd.Series(sizes).value_counts()
        runs, used = sharding.best_fit_decreasing([(s, s, n) for s, n in counts.items()], 50)
        bins, _ = brute_best_fit(sizes, 50)
        filled = [0] * used
        for c, a, b, k in runs:
            filled[k] += c * (b - a + 1)
        assert used == len(bins) and sorted(50 - f for f in filled) == sorted(bins)


def check_shards(got, n=None):
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    if n:
        assert set(got.shard) <= set(range(n))


def test_shards_of_equal_bytes(spark, docs):
    got = sharding.pack_into(docs, 8).toPandas()
    check_shards(got, 8)
    size = got.groupby("shard")["size"].sum()
    assert len(got) == docs.count() and size.max() - size.min() < 0.05 * size.mean()


def test_shards_of_a_capacity(spark, docs):
    got = sharding.pack(docs, 60_000).toPandas()
    check_shards(got)
    total = got.groupby("shard")["size"].sum()
    alone = got.groupby("shard").text_crc32.nunique() == 1
    assert (total[~alone] <= 60_000).all() and len(total) <= 1.3 * got["size"].sum() / 60_000 + 2


def test_large_groups_are_packed_by_their_exact_size(spark):
    rng, cap = random.Random(4), 10_000
    sizes = [cap // d - rng.randint(1, 40) for d in (2, 3, 4) for _ in range(60)]
    bins, _ = brute_best_fit(sizes, cap)
    got = sharding.pack(frame(spark, [f"{k:04d}".ljust(s - 1, "x") for k, s in enumerate(sizes)]), cap).toPandas()
    check_shards(got)
    assert got.shard.nunique() == len(bins) and got.groupby("shard")["size"].sum().max() <= cap


def test_one_group_of_a_third(spark):
    got = sharding.pack_into(frame(spark, ["same text"] * 40 + [f"text {k:05d}" for k in range(80)]), 8).toPandas()
    check_shards(got, 8)
    rest = got.groupby("shard")["size"].sum().sort_values()[:-1]
    assert len(rest) == 7 and rest.max() <= -(-80 // 7) * 11  # indivisible texts of 11 bytes


def test_shards_of_odd_rows(odd, empty):
    got = sharding.pack_into(odd, 8).toPandas()
    check_shards(got, 8)
    assert len(got) == len(ODD) and got["size"].min() == 1
    assert sharding.pack_into(empty, 8).count() == 0


# Benchmark decontamination.


def brute_tiles(item, doc, least):
    marked_i, marked_d, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and not marked_i[p + n] and not marked_d[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return sum(marked_i), sorted(x[2] for x in out)
        for k in range(n):
            marked_i[p + k] = marked_d[t + k] = True
        out.append((p, t, n))


def test_tiles_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abc" if rng.random() < 0.5 else "abcdefgh"
        item = [rng.choice(letters) for _ in range(rng.randint(4, 18))]
        doc = [rng.choice(letters) for _ in range(rng.randint(0, 10))] + rng.choice([[], item, item[len(item) // 2 :] + item[: len(item) // 2]]) + [rng.choice(letters) for _ in range(rng.randint(0, 10))]
        covered, lengths = brute_tiles(item, doc, tiling.MIN_MATCH)
        got = tiling.Matcher([(1, " ".join(item))], 0.0).matches(" ".join(doc))
        mine = sum(n for _, _, n in got[0][2]) if got else 0
        assert mine == covered and sorted(n for _, _, n in got[0][2]) == lengths if got else covered == 0


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box with five dozen liquor jugs near a frozen lake"


def test_contaminated_documents(spark):
    words = PASSAGE.split()
    moved = " ".join(["intro words here", *words[12:], "and then", *words[:12], "the end"])
    texts = [f"some text {PASSAGE} more text", moved, " ".join(words[:6]), "clean text of its own that shares nothing", None, "", PASSAGE.upper()]
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    got = tiling.contaminated(frame(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 1), (1, 1), (6, 1)}
    kept = tiling.clean(frame(spark, texts).withColumn("item_id", F.lit("x")), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5] and "item_id" in kept.columns


def test_tiles_of_texts_that_repeat_themselves():
    rng = random.Random(12)
    for _ in range(200):
        v = rng.randint(1, 4)
        item = np.array([rng.randrange(v) for _ in range(rng.randint(4, 30))])
        doc = np.array([rng.choice([*range(v), -1]) if rng.random() < 0.2 else rng.randrange(v) for _ in range(rng.randint(4, 60))])
        h, g = tiling.rolling(item, tiling.MIN_MATCH), tiling.rolling(doc, tiling.MIN_MATCH)
        at = np.array([k for k in range(len(g)) if (doc[k : k + tiling.MIN_MATCH] >= 0).all() and g[k] in set(h.tolist())], dtype=np.int64)
        assert tiling.tiles(item, doc, h, at, g[at]) == tiling.tiles_by_length(item, doc)


def test_memory_of_texts_that_repeat_themselves():
    import tracemalloc

    matcher, text = tiling.Matcher([(1, "a " * 1000)]), "a " * 300_000
    tracemalloc.start()
    assert matcher.matches(text) == [(1, 1.0, [(0, 0, 1000)])]
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_contaminated_rows_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    words = lambda t: [w for w in re.findall(r"\w+", (t or "").lower())]
    want = {}
    for d, t in docs:
        w = words(t)
        seeds = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        for i, u in items:
            x = words(u)
            if any(tuple(x[k : k + 4]) in seeds for k in range(len(x) - 3)):
                known = {y: k for k, y in enumerate(dict.fromkeys(x))}
                c = sum(n for *_, n in tiling.tiles_by_length(np.array([known[y] for y in x]), np.array([known.get(y, -1) for y in w]))) / len(x)
                if c >= tiling.COVERAGE:
                    want[d, i] = c
    got = queries.op2_decontaminate(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in got} == want and len(got) == len(want) > 0


def test_benchmark_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"{PASSAGE} number {k} {k * k}") for k in range(12)], "item_id long, text string")
    d = frame(spark, [f"{PASSAGE} number {k} {k * k}" for k in range(12)])
    whole = sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(d, bench).collect())
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 500)
    assert sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(d, bench).collect()) == whole
    assert tiling.clean(d, bench).count() == 0
    many = bench.unionByName(bench.withColumn("item_id", F.col("item_id") + 100))  # every text twice
    assert len(whole) * 2 == tiling.contaminated(d, many).count()


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in tiling.contaminated(odd, bench).collect()) == [5, 6]
    assert tiling.clean(odd, bench).count() == len(ODD) - 2
    assert tiling.contaminated(empty, bench).count() == 0 and tiling.clean(odd, bench.where("false")).count() == len(ODD)


# BPE.


def test_bpe_equals_the_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    more = frame(spark, ["a <|endoftext|>b", "<|startoftext|>", "it's 12 o'clock, don't!", "ΑΣΣ ΟΔΟΣ́"], [101, 102, 103, 104])
    both = docs.unionByName(odd).unionByName(more)
    got = bpe.encode(both, path).collect()
    assert len(got) == both.count() and bpe.encode(empty, path).count() == 0
    texts = {}
    for r in both.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in got:
        want = [t.encode(x, add_special_tokens=False).ids for x in texts[r["doc_id"]]]
        assert r["ids"] in want and r["n_tokens"] == len(r["ids"])
        decoded = t.decode(r["ids"], skip_special_tokens=False)
        assert r["decoded"] == decoded and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()


def test_bpe_cache_is_bounded(monkeypatch):
    b = bpe.WordBpe(queries.tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    first = b.encode_batch(["one two three four five", "six seven"])
    assert first == b.encode_batch(["one two three four five", "six seven"])


# URL filters.


def brute_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


URLS = [None, "", "nothing", "http://", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en", "https://example.com/en/", "https://xexample.com/en/", "http://b.net/es/q", "http://net/fr/", "http://net/de/", "http://a.com?x=/y", "a://b://c.com/", "http://x.com#/en/", "http://É.com/\nq", "http://a.com:80/"]
URLS += ["http://a b.com/x", "http://a b.net/es/1", "http:// .net/fr/", "http://a\tb.net/es/", "http://a\nb.example.com/en/", "http://.com/", "http://net./es/", "http://b.net /es/", "http://..net/es/é"]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(5, URLS[5])], "page_id long, url string")
    got = url_rules.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_judge(URLS[r["page_id"]], queries.URL_RULES)
    assert url_rules.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_rules_on_random_hosts():
    rng, rules = random.Random(7), [url_rules.Rule(*r) for r in queries.URL_RULES]
    index = url_rules.RuleIndex(rules)
    for _ in range(3000):
        url = "http://" + "".join(rng.choice([" ", "\t", ".", ".", "a", "net", "com", "example", "www", "\n"]) for _ in range(rng.randint(0, 7))) + rng.choice(["", "/", "/en/", "/es/x", "/fr", "/fr/", " /es/"])
        host, path, name, verdict = brute_judge(url, queries.URL_RULES)
        won = index.winner(host, path)
        assert (won.name if won else None, won.verdict if won else "allow") == (name, verdict), url


def test_rules_in_blocks(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    whole = sorted(map(str, url_rules.judge(pages, queries.URL_RULES).collect()))
    monkeypatch.setattr(url_rules, "MAX_RULES", 2)
    assert sorted(map(str, url_rules.judge(pages, queries.URL_RULES).collect())) == whole


# SimHash.


def brute_fingerprint(text, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= bits) for i in range(len(fps))]
        if new == label:
            break
        label = new
    least = {}
    for i, c in zip(ids, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in label]


def test_simhash_equals_brute_force(spark, docs, odd):
    both = docs.select("doc_id", "text").limit(120).unionByName(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    fps = [brute_fingerprint(t, 4) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, brute_components([i for i, _ in rows], fps, 4)), key=str)
    got = sorted([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()], key=str)
    assert got == want


def test_near_pairs_finds_every_pair(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << k
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(x),) for x in fps], "node long")
    nodes = classes.select("node", F.lit(0).alias("table"), F.col("node").alias("fp"), F.col("node").alias("label"))
    listed = [tuple(r) for r in simhash.near_pairs(nodes).collect()]
    got = set(listed)
    assert len(listed) == len(got)
    order = sorted(map(signed, fps))
    want = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("n", [200, 800])
def test_dense_groups_are_not_paired_out(spark, n):
    rng, base = random.Random(n), random.Random(5).getrandbits(64)
    fps = {base}
    while len(fps) < n:
        fps.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    nodes = spark.createDataFrame([(f - (f >> 63 << 64), 0) for f in fps], "node long, table int").withColumns({"fp": F.col("node"), "label": F.col("node")})
    assert simhash.pivot_pairs(nodes).count() <= len(simhash.SEGMENTS) * n
    labels = components.components(simhash.pivot_pairs(nodes))
    left = simhash.near_pairs(nodes.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    assert left.count() <= n
    found = simhash.near_components(nodes.drop("label")).collect()
    assert len(found) == n and {r["label"] for r in found} == {min(f - (f >> 63 << 64) for f in fps)}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(100, k) for k in range(101, 180)]
    got = components.components(spark.createDataFrame(chain + star + [(7, 7), (3, 2)], "u long, v long")).collect()
    assert {r["node"]: r["label"] for r in got} == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 180)}} and len(got) == 140
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark, empty):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    long = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(6)]
    near = long[0].split()
    near[70] = "changed"
    texts = [long[0], long[0], " ".join(near), *long[1:], None, "", long[5], long[5]]
    d = frame(spark, texts, [10, 11, 12, 13, 14, 15, 16, 17, 20, 21, 30, 30]).withColumn("component_id", F.lit(1))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [10, 13, 14, 15, 16, 17, 20]
    assert simhash.keep_one(empty).count() == 0
    twice = frame(spark, [long[0], long[0], long[1]], [1, 1, 2])
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == [1, 2]


def test_keep_one_without_ids_and_with_repeated_ones(spark):
    words = [f"w{k}" for k in range(60)]
    base, near, far, other = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:30]), "six words that stand quite alone"
    d = spark.createDataFrame([(None, base, "n"), (None, base, "n"), (3, base, "n"), (4, near, "n"), (5, far, "n"), (5, other, "n"), (None, "lonely text", "n"), (None, "lonely text", "n")], "doc_id long, text string, node string")
    d = d.withColumns({"key": F.lit(1), "first": F.lit("f"), "id": F.lit(2), "k": F.lit("k"), "at": F.lit(0)})
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted([(3, base), (5, far), (5, other), (None, "lonely text")], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {i: set(simhash.hashes(t, 5)) for i, t in rows}
    inverted = {}
    for i, s in sets.items():
        for h in s:
            inverted.setdefault(h, []).append(i)
    close = {(a, b) for l in inverted.values() for k, a in enumerate(l) for b in l[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert len(close) > 50 and sum(found[a] == found[b] for a, b in close) >= 0.9 * len(close)


def jaccard_components(rows, similarity=0.8):
    """The least id of each id's component, links being a Jaccard similarity of the shingle sets."""
    sets = {i: frozenset(simhash.hashes(t or "", 5)) for i, t in rows}
    inverted, least = {}, {i: i for i in sets}
    for i, s in sets.items():
        for h in s or ["none"]:
            inverted.setdefault(h, []).append(i)

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for l in inverted.values():
        for k, a in enumerate(l):
            for b in l[:k]:
                u, v = find(a), find(b)
                if u != v and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                    least[max(u, v)] = min(u, v)
    return {i: find(i) for i in sets}


def test_similar_components_against_brute_force(spark):
    """No false link; of documents that brute force puts below another, nearly all are (SimHash finds candidates with a chance)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = jaccard_components([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    below = [i for i, c in want.items() if c != i]
    assert len(below) > 40 and sum(got[i] == want[i] for i in below) >= 0.95 * len(below)


# Licences.


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1000, 200).astype(np.uint64)
    places = license_scan.winnow(h, 4)
    assert all(any(k <= p < k + 4 for p in places) for k in range(197))
    assert license_scan.winnow(h[:2], 4) and license_scan.winnow(h[:0], 4) == []


def brute_align(template, words):
    best = [[0] * (len(words) + 1)]
    for want in template:
        row = [best[-1][0] - 1]
        for k, w in enumerate(words):
            row.append(max(best[-1][k] + (1 if w == want else -1), best[-1][k + 1] - 1, row[-1] - 1))
        best.append(row)
    return max(best[-1])


def test_alignment_scores_equal_the_full_table():
    rng = random.Random(8)
    for _ in range(100):
        t = [rng.randint(0, 5) for _ in range(rng.randint(1, 8))]
        w = [rng.randint(0, 5) for _ in range(rng.randint(1, 9))]
        score, fit, first, end = license_scan.align(np.array(t), np.array(w), -10, 10)
        assert score == brute_align(t, w)
        assert fit <= len(t) and (first == -1 or w[first] in t and w[end - 1] in t)


APACHE, BSD_3 = (next(t for n, t in license_scan.TEMPLATES if n == name and len(t) > 200) for name in ("Apache-2.0", "BSD-3-Clause"))
#: Lines that differ from another licence's in a word or a number, and what they are.
PROBES = [
    ("Licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Licensed under the GNU General Public License, version 1.", ["GPL-1.0"]),
    ("Licensed under the GNU General Public License, version 2.7.", []),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("Licensed under the BSD 4-Clause License.", ["BSD-4-Clause"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ["MPL-1.1"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
    ("Licensed under CC BY-XX 4.0.", []),
    ("Licensed under CC BY-SA 3.0.", ["CC-BY-SA-3.0"]),
    (APACHE.replace("specific", "particular"), ["Apache-2.0"]),
    (BSD_3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), ["BSD-3-Clause"]),
]


@pytest.mark.parametrize("text, want", PROBES)
def test_licences_of_nearly_one_wording(text, want):
    found = license_scan.Scanner(license_scan.TEMPLATES).finds(f"Before it. {text} After it")
    assert [f[0] for f in found] == want
    assert all(f[4] - f[3] >= len(text) - 8 for f in found)


def brute_finds(text, templates, coverage):
    """Licence and share of the finds, each template held against all words by a full table."""
    words, found = re.findall(r"\w+", text.lower()), []
    for k, (name, notice) in enumerate(templates):
        want = re.findall(r"\w+", notice.lower())
        table = [[(0, 0, -1, -1)] * (len(words) + 1)]  # score, words that fit, first, last
        for x in want:
            above, row = table[-1], []
            for j in range(len(words) + 1):
                options = [(above[j][0] - 1, *above[j][1:])]
                if j:
                    s, fit, first, _ = above[j - 1]
                    options.append((s + 1, fit + 1, j - 1 if first < 0 else first, j - 1) if words[j - 1] == x else (s - 1, *above[j - 1][1:]))
                    options.append((row[-1][0] - 1, *row[-1][1:]))
                row.append(max(options, key=lambda o: (o[0], o[1])))
            table.append(row)
        _, fit, first, last = max(table[-1], key=lambda o: (o[0], o[1]))
        share = (fit - max(0, last + 1 - first - len(want))) / len(want)
        if share >= (1 if len(want) <= license_scan.WHOLE else coverage) and license_scan.telling(words[max(0, first - 1) : last + 1]) == license_scan.telling(want):
            found.append((-fit, -share, k, first, last + 1))
    out = []
    for f in sorted(found):
        if all(f[4] <= o[3] or f[3] >= o[4] for o in out):
            out.append(f)
    return [(templates[f[2]][0], -f[1]) for f in sorted(out, key=lambda f: f[3])]


def test_finds_equal_brute_force():
    rng, scanner = random.Random(21), license_scan.Scanner(license_scan.TEMPLATES)
    filler = [f"filler{k}" for k in range(50)]
    for _ in range(25):
        _, notice = rng.choice(license_scan.TEMPLATES)
        words = notice.split()
        for _ in range(len(words) // 25):
            words[rng.randrange(len(words))] = rng.choice(filler)
        text = " ".join(rng.choices(filler, k=rng.randint(0, 20)) + words + rng.choices(filler, k=rng.randint(0, 20)))
        assert [(f[0], f[1]) for f in scanner.finds(text)] == brute_finds(text, license_scan.TEMPLATES, license_scan.COVERAGE)


def test_licences(spark, odd, empty):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    words = mit.split()
    words[20] = "CHANGED"
    del words[50]
    texts = ["Text. Released under the MIT License. More text.", "This work is licensed under the GNU General Public License, version 3.", "a " * 500 + " ".join(words) + " b", "nothing of the kind", "İİ İ. Licensed under the Apache License, Version 2.0. And\nLICENSED UNDER CC BY-NC 4.0!"]
    got = license_scan.scan(frame(spark, texts)).collect()
    found = {(r["doc_id"], r["license"]) for r in got}
    assert found == {(0, "MIT"), (1, "GPL-3.0"), (2, "MIT"), (4, "Apache-2.0"), (4, "CC-BY-NC-4.0")}
    for r in got:
        span = texts[r["doc_id"]][r["span_start"] : r["span_end"]]
        assert r["coverage"] >= 0.8 and span.split()[0].lower() in ("released", "this", "permission", "licensed")
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


# Quality.


def test_quality_separates_junk(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)) for _ in range(200)]
    junk = [" ".join(rng.choice("### $$$ %%% &&& @@@ !!!".split()) for _ in range(60)) for _ in range(40)]
    d = frame(spark, good + junk)
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels).toPandas().set_index("doc_id").selected.sort_index()
    assert got[:200].mean() > 0.98 and got[200:].mean() < 0.05
    kept = quality.keep_selected(d, labels)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(got[got].index)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got[got.quality == 1].selected.mean() > 0.95 and got[got.quality == 0].selected.mean() < 0.35


def test_worst_window_equals_brute_force():
    rng = np.random.default_rng(3)
    ratio = rng.normal(size=500)
    for n in (1, 2, 49, 50, 51, 130):
        words = [f"w{k}" for k in rng.integers(0, 90, n)]
        h = [zlib.crc32(w.encode()) for w in words]
        pairs = [(a * 2654435761 + b) % (1 << 64) % 500 for a, b in zip(h, h[1:])]
        means = []
        for k in range(max(1, n - 49)):
            part = [ratio[x % 500] for x in h[k : k + 50]] + [ratio[x] for x in pairs[k : k + 50]]
            means.append(sum(part) / len(part))
        assert np.isclose(quality.worst_window(" ".join(words), ratio), 100 * min(means))


def test_classification_equals_brute_force(spark):
    """The models, the weights, the cut and the draw again, by plain counting."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    buckets, window = quality.BUCKETS, quality.WINDOW

    def numbers(text):
        h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
        return [x % buckets for x in h], [((a * 2654435761 + b) & (1 << 64) - 1) % buckets for a, b in zip(h, h[1:])]

    def ids(condition):
        return [r[0] for r in labels.where(condition).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]

    good, bad = ids("quality = 1 and toxic = 0"), ids("not (quality = 1 and toxic = 0)")
    raw, target = [0] * buckets, [0] * buckets
    for i, t in docs:
        for x in sum(numbers(t), []):
            raw[x] += 1
            target[x] += i in set(good[::2])
    ratio = [np.log((a + 1) / (sum(target) + buckets)) - np.log((b + 1) / (sum(raw) + buckets)) for a, b in zip(target, raw)]
    weight = {}
    for i, t in docs:
        one, two = numbers(t)
        each = [ratio[x] + (ratio[two[k]] if k < len(two) else 0) for k, x in enumerate(one)]
        if len(one) <= window:
            weight[i] = sum(each) / (2 * len(one) - 1) * 2 * window if one else 0.0
        else:
            weight[i] = min(sum(each[k : k + window]) * (2 * window / (2 * window - 1) if k == len(one) - window else 1) for k in range(len(one) - window + 1))
    cut = quality.best_cut(np.array([weight[i] for i in good[1::2]]), np.array([weight[i] for i in bad]))
    noise = {r[0]: -np.log(-np.log(((r[1] % (1 << 64) >> 11) + 0.5) / (1 << 53))) for r in spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.xxhash64(F.lit(quality.SEED), "doc_id", F.coalesce("text", F.lit("")))).collect()}
    k = sum(w >= cut for w in weight.values())
    drawn = set(sorted(weight, key=lambda i: -(weight[i] + noise[i]))[:k])
    got = {r["doc_id"]: r for r in queries.op7_importance_resampling(spark, SF).collect()}
    assert set(got) == set(weight) and 0 < k < len(docs)
    assert max(abs(got[i]["log_weight"] - weight[i]) for i in weight) < 1e-6
    assert {i for i, r in got.items() if r["selected"]} == drawn


def test_one_row_does_not_set_the_cut():
    good = np.arange(149.0)
    assert quality.best_cut(good, np.array([])) > good.min()
    assert quality.best_cut(np.append(good, -500.0), np.full(50, -20.0)) > -20


def test_kept_shares_by_label_class(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    kept = got.groupby(["quality", "toxic"]).selected.mean()
    print(got.groupby(["quality", "toxic"]).selected.agg(["sum", "count"]))
    assert kept[1, 0] > 0.95 and kept[0, 1] < 0.1 and kept[0, 0] < 0.08


def test_kth_largest(spark):
    rng = random.Random(6)
    x = [rng.choice([0.0, 1.5, -3.0, rng.random(), rng.random() * 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 2, 77, 250, 499, 500):
        assert quality.kth_largest(df, k) == sorted(x, reverse=True)[k - 1]


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, None), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == len(ODD) == quality.classify(odd, labels.limit(0)).where("selected").count()
    clash = odd.withColumns({"log_weight": F.lit("x"), "draw_key": F.lit(1), "__text": F.lit(2), "quality": F.lit(3)})
    kept = quality.keep_selected(clash, labels)
    assert kept.columns == clash.columns and kept.where("log_weight <> 'x' OR draw_key <> 1").count() == 0 < kept.count()
    assert quality.classify(empty, labels).count() == 0 and quality.keep_selected(empty, labels).count() == 0


# Token counts.


def test_counts_equal_the_library(spark, docs, odd, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    counter = token_count.Counter(path)
    both = docs.unionByName(odd)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(both, path).collect()), key=str)
    want = []
    for r in both.collect():
        t = r["text"] or ""
        n = counter.lengths([t])[0]
        want.append((r["doc_id"], len(t.encode()), n, n > 1024))
    assert got == sorted(want, key=str) and token_count.count_tokens(empty, path).count() == 0


def test_resynchronisation():
    counter = token_count.Counter(queries.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    letters = "ab '\n\t\x1c\x85é漢🙂12.-  \n  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x"]) for _ in range(800)] + [" " * 300, "\n" * 299 + "x", "x" * 500, "<|endoftext|>" * 40]
    want = counter.lengths(texts)
    for chunk, overlap in ((16, 3), (40, 10), (64, 1)):
        assert counter.count_batch(texts, chunk, overlap) == want


# Ogg.


def test_ogg_round_trip_and_damage():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 254, 255, 256, 1024, 40_000, 200_000):
        payload = ogg_media.payload_of("".join(rng.choice("abcé") for _ in range(n)))
        assert len(payload) % 64 == 0 and payload
        media = ogg_media.pack(payload)
        back, packets = ogg_media.unpack(media)
        assert back == payload and len(ogg_media.demultiplex(media)) == 2
        assert max(p.seconds for p in packets if p.seconds is not None) == len(payload) / ogg_media.RATE
        for at in rng.sample(range(len(media)), 5):
            with pytest.raises(ValueError):
                ogg_media.unpack(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ValueError):
            ogg_media.unpack(media[: len(media) // 2])


def test_ogg_packets_over_pages_and_checksum():
    data = bytes(range(256)) * 400
    pages = ogg_media.pages(7, [(b"head", 0), (data, 5)])
    assert len(pages) > 3 and ogg_media.demultiplex(b"".join(pages))[7][1].data == data
    with pytest.raises(ValueError):
        ogg_media.demultiplex(b"".join(pages[:2] + pages[3:]))
    plain = 0
    for b in b"123456789":
        plain ^= b << 24
        for _ in range(8):
            plain = (plain << 1 ^ (0x04C11DB7 if plain >> 31 else 0)) & 0xFFFFFFFF
    assert ogg_media.page_checksum(b"123456789") == plain


def test_ogg_column(spark, odd, empty):
    got = ogg_media.roundtrip(odd).collect()
    texts = [t or "" for t in ODD]
    assert len(got) == len(ODD) and ogg_media.roundtrip(empty).count() == 0
    for r in got:
        payload = next(p for p in map(ogg_media.payload_of, texts) if hashlib.sha256(p).hexdigest() == r["payload_sha256"])
        assert r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert len({r["media_sha256"] for r in got if r["doc_id"] == 3}) == 1


# WARC.


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    blob = "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(30_000))
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>") for k in range(40)] + [(90, None, None), (91, "http://é/\r\nX: y", ""), (None, "u", "null id"), (92, "a b", blob), (93, "c", blob), (39, "http://x/39", "<p>4</p>")]
    path = f"file://{tmp_path}/w"
    assert warc.write(pages_of(spark, rows).repartition(3), path) == len(rows)
    for size in (500, 7777, 1 << 20):
        got = warc.read(spark, path, range_bytes=size).collect()
        assert len(got) == len(rows)
    by_text = {}
    for i, _, t in rows:
        by_text.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t or "" for i, _, t in rows if i == r["page_id"])
        last = max((i for i in by_text[text] if i is not None), default=None)
        assert r["payload_bytes"] == len(text.encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
        assert r["payload"] == (text.encode() if r["record_type"] == "response" else None)


def test_warc_false_magic(tmp_path):
    import io

    noise = warc.MAGIC * 50 + os.urandom(3000)
    data = b"junk" + b"".join(warc.gzip_member(warc.record(k, "u", noise + bytes([k]), hashlib.sha1(noise + bytes([k])).hexdigest(), None), level=0) for k in range(5))
    for step in (100, 1000, len(data)):
        found = [r["warc-record-id"] for a in range(0, len(data), step) for r in warc.records(io.BytesIO(data), len(data), a, a + step)]
        assert found == [f"<urn:page:{k}>" for k in range(5)]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(io.BytesIO(data[:-50]), len(data) - 50, 0, len(data)))


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(pages_of(spark, [(1, "u", "one"), (2, "u", "two")]).repartition(1), path)
    whole = next((tmp_path / "w").glob("*.warc.gz"))
    (tmp_path / "w" / "part-000000-lost.warc.gz").write_bytes(whole.read_bytes()[:-20])
    assert sorted(r["page_id"] for r in warc.read(spark, path).collect()) == [1, 2]


def test_warc_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert warc.write(pages_of(spark, []), path) == 0 and warc.read(spark, path).count() == 0


# Kept columns that are named like results.


def test_clashing_names(spark):
    d = frame(spark, ["Licensed under the MIT License.", None], [1, 2])
    for name in ("text_", "host", "coverage", "license", "n_tokens", "size", "media", "item_id"):
        d = d.withColumn(name, F.concat(F.lit("own "), F.col("doc_id")))
    keep = ("doc_id", "text", "host", "coverage", "license", "n_tokens", "size", "media", "item_id")
    bench = spark.createDataFrame([(7, "licensed under the mit license")], "item_id long, text string")
    outs = [sharding.pack_into(d, 2, keep), tiling.contaminated(d, bench, keep=keep), bpe.encode(d, queries.tokenizer_path("word_bpe_49k.json"), keep), url_rules.judge(d, queries.URL_RULES, keep, "text"), license_scan.scan(d, keep=keep), token_count.count_tokens(d, queries.tokenizer_path("byte_bpe_50k.json"), keep=keep), ogg_media.roundtrip(d, keep)]
    for out, own in zip(outs, ("_size", "_coverage", "_n_tokens", "_host", "_license", "_n_tokens", "_media")):
        assert len(set(out.columns)) == len(out.columns)
        assert all(r[own] == f"own {r['doc_id']}" for r in out.collect())


# Registered queries.


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    mine = queries.queries()[name](spark, SF).toPandas()
    theirs = con.execute(queries.oracle_sql()[name]).df()
    show = lambda d: sorted(str([None if pd.isna(v) else int(v) if isinstance(v, (float, np.integer)) else v for v in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert sorted(mine.columns) == sorted(theirs.columns) and show(mine) == show(theirs)


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


MARKS = {
    "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "SPDX-License-Identifier: AGPL-3.0": "AGPL-3.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0", "It comes under the GNU GPL v2 or later, they say": "GPL-2.0",
    "Under GNU LGPL v2.1 here": "LGPL-2.1", "GNU Affero General Public License version 3": "AGPL-3.0", "GNU General Public License v3": "GPL-3.0", "BSD 4-Clause License": "BSD-4-Clause", "See The MIT License for it": "MIT",
    "This is not released under the MIT License.": None, "never licensed under CC BY 4.0.": None, "SPDX-License-Identifier: Foo-1.0": None, "Released under the Foo License.": None, "Notably released under the MIT License.": "MIT",
}


@pytest.mark.parametrize("text", MARKS)
def test_licence_marks(text):
    found = license_scan.Scanner(license_scan.TEMPLATES).finds(text)
    assert [f[0] for f in found] == ([MARKS[text]] if MARKS[text] else [])


def test_repeated_words_of_a_notice_cost_little():
    import time

    notice = max((t for _, t in license_scan.TEMPLATES), key=len)
    text = " ".join(notice.split()[:6]) + " "
    scanner, began = license_scan.Scanner(license_scan.TEMPLATES), time.process_time()
    assert scanner.finds(text * 20_000) == [] and time.process_time() - began < 12


def test_templates_in_blocks_give_the_same_finds(spark, docs, odd, monkeypatch):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(MARKS)), "doc_id long, text string"))
    want = sorted(map(str, license_scan.scan(both).collect()))
    monkeypatch.setattr(license_scan, "BLOCK_LETTERS", 3_000)
    assert len(license_scan._blocks(license_scan.TEMPLATES)) > 1
    assert sorted(map(str, license_scan.scan(both).collect())) == want and want
