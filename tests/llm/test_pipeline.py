"""The pipeline's stages, each on its own input, against what brute force keeps."""

import corpus_pipeline as cp
import numpy as np
import pytest
from corvane.llm import quality, simhash, tiling
from corvane.llm.common import read

SF = "/root/testdata/sf0.001"


def jaccard_firsts(rows):
    """Of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: the least id."""
    sets = {i: frozenset(simhash.hashes(t or "", 5)) for i, t in rows}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                u, v = find(a), find(b)
                least[max(u, v)] = min(u, v)
    return sorted({find(i) for i in order})


def stages(spark, start):
    """Each stage but the last: its name, its input's rows, its output's rows."""
    docs = before = start
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        rows = after.collect()
        yield name, before.collect(), rows
        before = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    assert cp.STAGES[-1][1](spark, before, SF).count() == before.count()


def test_stages(spark):
    labels = {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}
    matcher = tiling.Matcher([(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()])
    for name, before, after in stages(spark, read(spark, SF, "documents")):
        ids = sorted(r["doc_id"] for r in after)
        assert len(ids) == len(set(ids)) and set(map(tuple, after)) <= set(map(tuple, before))
        if name == "quality":
            good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
            assert np.mean([i in set(ids) for i in good]) >= 0.9
        if name == "simhash":
            assert ids == jaccard_firsts([(r["doc_id"], r["text"]) for r in before])
        if name == "decontamination":
            assert ids == sorted(r["doc_id"] for r in before if not matcher.matches(r["text"] or ""))


def test_odd_rows(spark):
    docs = read(spark, SF, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, "word", None, "s", 4), (9003, "long " * 30_000, "en", "s", 5)], docs.schema)
    for name, before, after in stages(spark, docs.unionByName(odd)):
        assert set(map(tuple, after)) <= set(map(tuple, before)), name


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_empty_table(spark, k):
    docs = read(spark, SF, "documents").limit(0)
    assert cp.STAGES[k][1](spark, docs, SF).count() == 0


def test_run(spark):
    assert len(cp.STAGES) == 4 and 0 < cp.run(spark, SF).count() < read(spark, SF, "documents").count()


def test_whole_run_equals_brute_force(spark, tmp_path):
    """Null, empty, repeated and very long rows, copies and near copies, columns named like inner ones: what run() keeps, stage after stage."""
    base = read(spark, SF, "documents").limit(120)
    rows = [tuple(r) for r in base.collect()]
    long = rows[3][1] + " and so on" * 3000
    words = rows[5][1].split()
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, "word", None, "s", 4), (9003, long, "en", "s", 5)]
    odd += [(9004, rows[5][1], "en", "s", 5), (9005, " ".join([*words[:-1], "changed"]), "en", "s", 5), (9006, rows[7][1].upper(), None, None, None)]
    leak = read(spark, SF, "benchmark").first()["text"]
    odd.append((9007, f"{rows[8][1]} {leak} {rows[9][1]}", "en", "s", 5))
    docs = spark.createDataFrame(rows + odd, base.schema).selectExpr("*", "1 as key", "'x' as node", "2.0 as log_weight", "doc_id as __key")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        read(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    got = sorted(((r["doc_id"], r["lang"], r["decoded_sha256"]) for r in cp.run(spark, str(tmp_path)).collect()), key=str)
    judged = quality.classify(docs, read(spark, str(tmp_path), "labels")).collect()
    selected = {r["doc_id"] for r in judged if r["selected"]}
    assert {r["doc_id"] for r in judged if not r["selected"]}.isdisjoint(selected)  # one id is one decision here
    left = [r for r in docs.collect() if r["doc_id"] in selected]
    sets = [frozenset(simhash.hashes(r["text"] or "", 5)) for r in left]
    group = list(range(len(left)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(left)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                group[top(a)] = top(b)
    firsts = {}
    for k, r in enumerate(left):
        name = (r["doc_id"] is None, r["doc_id"] or 0)
        firsts[top(k)] = min(firsts.get(top(k), (name, k)), (name, k))
    matcher = tiling.Matcher([(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()])
    want = [left[k] for _, k in firsts.values() if not matcher.matches(left[k]["text"] or "")]
    kept = sorted(((r["doc_id"], r["lang"]) for r in want), key=str)
    assert sorted(((d, lang) for d, lang, _ in got), key=str) == kept and 0 < len(kept) < len(rows)
    assert len({d for d, _, _ in got}) == len(got)


def test_pivots_of_a_group_grow_with_its_nodes_only(spark):
    """Sixteen pivots a start: links of a dense group by more than one node, all of them near, of unlike labels, and no more than pivots times starts."""
    from corvane.llm import simhash

    rows = [(k, 0, (0x1234_5678_9ABC_DEF0 >> 1) ^ (1 << k), k if k else 1) for k in range(52)]
    nodes = spark.createDataFrame(rows, "node long, table int, fp long, label long")
    near = {tuple(r) for r in simhash.near_pairs(nodes).collect()}
    one, many = ([tuple(r) for r in simhash.pivot_pairs(nodes, 1, None, n).distinct().collect()] for n in (1, 16))
    assert set(one) <= near and set(many) <= near and (0, 1) not in many
    assert len(near) > 1000 and 3 * len(one) < len(many) <= 16 * 5 * len(rows)
    reached = {1}
    while more := {x for p in many for x in p if set(p) & reached} - reached:
        reached |= more
    assert len(reached) >= 50
