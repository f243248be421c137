"""Packing, Merkle manifest and prefix trie against the library, plain hashing and plain counting."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle, packing, prefix_trie, queries

SF = "/root/testdata/sf0.001"
#: Null, empty, white space, very long, repeated rows, special tokens, letters that normalizers change.
ODD = [None, "", "   \n", "word", "word", "a b c d e f g h", "x" * 60_000, "lorem ipsum dolor " * 20_000, "Ünïcödé ß İ 漢字 🙂", "\x00\x1c\x85", "a<|endoftext|>b <|ENDOFTEXT|>", "café Å ŉ"]


# Packing.


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("slice_", [packing.SLICE, 1000])
def test_ids_are_the_librarys(slice_, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", slice_)
    texts = [t or "" for t in ODD]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    ids = packing.TextIds(queries.tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == want
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 3)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts, 2)] == [w + [2] for w in want]


def test_ids_of_odd_letters():
    """Letters that the library counts and Python's tables may not (U+0558, U+088F, U+10940), white space of every kind, special tokens between words."""
    pick = random.Random(5)
    signs = [*"abcS's ,.|\"_0\t\n\x0b\x1c\x1f\x85\xa0\u2028\u3000\u200b", *"\u0558\u088f\U00010940ÉßİŉǅЖ漢🙂\u0301가", "<|endoftext|>", "<|startoftext|>", "<|", " 's"]
    texts = [f"a{chr(c)}b {chr(c)}" for c in (0x558, 0x88F, 0x10940)] + ["".join(pick.choices(signs, k=pick.randrange(40))) for _ in range(3000)]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    ids = packing.TextIds(queries.tokenizer_path("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == want


def test_words_are_tokenised_once_a_worker(monkeypatch):
    """The next task of a call asks the model for nothing that its worker knows, another call does; long chunks are not kept."""
    path, asked = queries.tokenizer_path("word_bpe_49k.json"), []
    monkeypatch.setattr(packing, "_KNOWN", {})
    first = packing.text_ids(path, "a call")
    monkeypatch.setattr(first, "tokenize", lambda word, of=first.tokenize: asked.append(word) or of(word))
    text = "one word, another word. " + "y" * 1000
    ids = first.encode([text, text], 2)
    assert sorted(asked) == sorted(["one", "word", ",", "another", ".", "y" * 1000])
    asked.clear()
    assert packing.text_ids(path, "a call").encode([text], 2) == ids[:1] and asked == ["y" * 1000]
    assert max(map(len, first.cache)) <= packing.LONGEST
    assert not packing.text_ids(path, "another").cache and len(packing._KNOWN) == 1


def held(pieces, ids, limits):
    """Every id once, sequences gapless and within their limits; their lengths."""
    by = defaultdict(list)
    for p in pieces:
        by[p["key"]].append(p)
    assert set(by) == {k for k, v in ids.items() if len(v)}
    for k, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = np.array(ids[k][at : at + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids[k]) and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids[k])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(p["loss"] for p in own) <= limits.loss
    return [sum(p["length"] for p in own) for own in sequences.values()]


def test_packed_documents(spark):
    odd = spark.createDataFrame(list(enumerate(ODD)), "key long, text string").withColumn("start", F.lit(7))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("key"), "text").where("key >= 12").withColumn("start", F.lit(7)).unionByName(odd)
    found = [r.asDict() for r in packing.pack_texts(docs, queries.tokenizer_path("word_bpe_49k.json"), keep=("key", "start")).collect()]
    assert all(r["_start"] == 7 for r in found)
    rows = docs.collect()
    ids = {r["key"]: e.ids + [2] for r, e in zip(rows, library().encode_batch([r["text"] or "" for r in rows], add_special_tokens=False))}
    lengths = held(found, ids, packing.Limits())
    assert all(n & (n - 1) == 0 for n in lengths)  # no padding at all
    assert all(r["ids"] == ids[r["key"]][r["start"] : r["start"] + r["length"]] for r in found)
    assert len(found) < 2 * len(rows)


def test_packed_instructions(spark):
    """Indivisible examples under all three limits at once; the query of the limits that bind leaves little room."""
    pick = random.Random(3)
    rows = [(k, [pick.randrange(1000) for _ in range(n)], pick.randrange(n + 1)) for k, n in enumerate(pick.choices([0, 1, 5, 40, 90, 150], k=1500))]
    limits = packing.Limits(tokens=256, segments=8, loss=128)
    df = spark.createDataFrame(rows, "key long, ids array<int>, bearing int").repartition(3)
    found = [r.asDict() for r in packing.pack_ids(df, limits, keep=("key",), loss="bearing").collect()]
    ids = {k: v for k, v, _ in rows}
    lengths = held(found, ids, limits)
    cut = {r["key"] for r in found if r["length"] < r["doc_tokens"]}
    assert cut == {k for k, _, n in rows if n > limits.loss}  # cut only what no sequence takes whole
    loss = defaultdict(int)
    for r in found:
        loss[r["key"]] += r["loss"]
    assert all(loss[k] == n for k, v, n in rows if v)
    assert len(lengths) <= 1.03 * (first_fit([(len(v), 1, n) for _, v, n in rows if v and n <= limits.loss], limits) + sum(n > limits.loss for _, _, n in rows))


def first_fit(vectors, limits):
    bins = []
    for v in sorted(vectors, reverse=True):
        for b in bins:
            if all(x + y <= z for x, y, z in zip(b, v, limits)):
                b[:] = [x + y for x, y in zip(b, v)]
                break
        else:
            bins.append(list(v))
    return len(bins)


def test_packed_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_texts(empty, queries.tokenizer_path("word_bpe_49k.json")).count() == 0
    one = spark.createDataFrame([(1, None, None), (2, [], 0)], "doc_id long, ids array<int>, n int")
    assert packing.pack_ids(one, loss="n").count() == 0
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(tokens=0))
    with pytest.raises(ValueError):
        list(packing.Packer(packing.Limits()).add(3, 4))


# Merkle manifest.


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root, and for each leaf its siblings as (side, hash)."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, a in enumerate(at):
            other = a ^ 1
            proofs[k].append(("R" if other > a else "L", level[other]) if other < len(level) else None)
        level = [sha(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [a // 2 for a in at]
    return (level or [None])[0], proofs


def brute_manifest(rows, fields, moved):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = [(r, sha(*[enc(r[f]) for f in fields]), sha(*[enc(v) for v in moved(r)])) for r in rows]
    groups = defaultdict(list)
    for m in made:
        groups["" if m[0]["lang"] is None else "=" + m[0]["lang"]].append(m)
    order = sorted(groups, key=lambda g: g.encode())
    for g in order:
        groups[g].sort(key=lambda m: (m[0]["doc_id"] is not None, m[0]["doc_id"] or 0, m[1], m[2]))
    trees = {g: brute_tree([m[1] for m in groups[g]]) for g in order}
    root, tops = brute_tree([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (r, leaf, other), own in zip(groups[g], trees[g][1]):
            steps, now = own + tops[k], other
            for s in steps:
                now = sha(now) if s is None else sha(now, s[1]) if s[0] == "R" else sha(s[1], now)
            out.append((r["doc_id"], leaf, trees[g][0], root, sha(*[s[1] for s in steps if s]), now, now == root))
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def moved(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
    return [r[f] + 1 if f == "n_chars" and hit and r[f] is not None else r[f] for f in FIELDS]


def manifest_rows(spark, rows, tmp_path, monkeypatch=None):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle(spark, str(tmp_path)).collect()
    want = brute_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], FIELDS, moved)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    return found


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    """Trees of 1 to 70 leaves, null and repeated ids, repeated rows, long texts, in blocks of 2, 4 and 1024 leaves."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    rows = []
    for lang, n in ((None, 3), ("", 1), ("de", 2), ("en", 70), ("z\U0001f642", 5), ("z", 8), ("fr", 33)):
        rows += [(len(rows) + k, f"text {k} é" * (k % 4), lang, None if k % 5 == 0 else "s", None if k % 3 == 0 else k, "x") for k in range(n)]
    rows += [rows[10], rows[10], (None, None, "en", None, None, "x"), (None, "y", "en", None, 4, "x"), (12, "z" * 300_000, "en", "s", 1, "x"), (-7, "", "en", "s", 1, "x")]
    found = manifest_rows(spark, rows, tmp_path)
    assert 0 < sum(not r["verified"] for r in found) < len(found)


def test_manifest_of_one_and_none(spark, tmp_path):
    found = manifest_rows(spark, [(5, "one", "en", "s", 3, "x")], tmp_path / "one")
    assert found[0]["leaf"] == found[0]["subroot"] == found[0]["root"]
    manifest_rows(spark, [], tmp_path / "none")


# Prefix trie.


def brute_trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(np.fmod(c, 5)), [])
        built[c] = base[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode() if node else b"")
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    end = lambda node: hashlib.sha256(",".join(str(c) for c in members[node] if len(built[c]) == len(node)).encode()).hexdigest()
    return [(members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], end(n)) for n in members]


def trie_rows(spark, turns, tmp_path):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(brute_trie(turns), key=key)
    return found


@pytest.mark.parametrize("band,rows,ends", [(4096, 100_000, 1 << 14), (2, 40, 4), (3, 25, 1), (7, 1000, 2)])
def test_trie(spark, tmp_path, monkeypatch, band, rows, ends):
    """Shared, equal, long, turnless and single-turn conversations, null turns and texts, over many shards and bands."""
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", rows)
    monkeypatch.setattr(prefix_trie, "ENDS", ends)
    pick, turns = random.Random(band), []
    for c in [*range(40), 101, 102, 103, 10**15 + 4, -3]:
        turns += [(c, t, pick.choice(["user", "system"]), pick.choice(["a", "bb", "é"])) for t in range(pick.randrange(1, 7))]
    for c in (50, 55, 60):  # long and equal but for the last one's end
        turns += [(c, t, "user", f"t{t % 7}" if (c, t) != (60, 24) else "other") for t in range(25)]
    turns += [(70, None, None, None), (70, None, "user", "first"), (70, 3, "user", None), (71, 0, "user", "x"), (71, 0, "user", "x"), (None, 0, "user", "lost"), (76, 0, "u", "gone")]
    trie_rows(spark, turns, tmp_path)


def test_trie_of_none(spark, tmp_path):
    trie_rows(spark, [], tmp_path)


def test_slot_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, (20_000, 2), dtype=np.uint64), axis=0)
    table = prefix_trie.SlotTable(keys)
    assert sorted(table.find(keys)) == list(range(len(keys)))  # minimal and perfect
    assert (table.find(keys ^ np.uint64(1)) == -1).all()  # a slot is trusted only for its own key
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.zeros((2, 2), dtype=np.uint64))


def test_colliding_digests_stop(spark):
    local = spark.createDataFrame([(1, 2, 3, 4, 5, 1, 9, 0), (1, 2, 3, 4, 6, 1, 9, 0)], "a long, b long, pa long, pb long, depth long, n long, least long, bytes long")
    with pytest.raises(Exception, match="two prefixes have one digest"):
        prefix_trie.node_table(local).collect()
