import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import audit, catalog, exclude, graph, hashrank, retrieval, splits

X = (
    "source int, target int, y_line_idx smallint, link_type string, paren string, raw_text string, stratum string, sync_id int, rank int, u int"
)


def mention(s, t, st="s3"):
    return (s, t, 0, "Cf.", "", "Cf.", st, 0, 5, 6)


def test_edges_keep_the_strongest_label(table):
    x = table(
        X,
        [
            mention(1, 2, "s3"),
            mention(1, 2, " S4"),
            mention(2, 1, "s3"),
            mention(3, 3),
            mention(None, 3),
            mention(3, None),
            mention(5, 4, None),
            mention(5, 4, None)
        ]
    )
    assert {tuple(r) for r in graph.pair_table(x).collect()} == {(1, 2, "s4"), (4, 5, None)}
    assert tuple(graph.mention_counts(x).first()) == (8, 1, 2, 5, 3, 2, 1, 1)
    nodes = table("id int", [(1,), (2,), (4,), (9,)])
    assert {tuple(r) for r in graph.degrees(x, nodes).collect()} == {
        (1, 1, 1, 1), (2, 1, 1, 1), (4, 0, 1, 0), (9, 0, 0, 0)
    }
    assert {r["scope"] + r["stratum"]: r["n"] for r in graph.stratum_counts(x, nodes).collect()} == {
        "directeds4": 1, "directeds3": 1, "directed(none)": 1, "undirecteds4": 1, "undirected(none)": 1, "withins4": 1
    }


def test_nothing(table):
    x, nodes = table(X), table("id int")
    assert (
        graph.pair_table(x).count() == 0
        and graph.degrees(x, nodes).count() == 0
        and graph.distribution(table("a int"), ["a"]).count() == 0
    )
    assert tuple(graph.mention_counts(x).first()) == (0,) * 8
    assert catalog.coverage(nodes, nodes).first()["share"] is None


def test_quantiles_interpolate(table):
    r = graph.distribution(table("a int", [(i,) for i in (1, 2, 2, 10)]), ["a"]).first()
    assert (r["n"], r["mean"], r["p50"], r["max"]) == (4, 3.75, 2.0, 10) and abs(r["p90"] - 7.6) < 1e-9


def test_hash_ranks_are_a_permutation_per_stratum(table):
    data = [(i, i * 7, "ab"[i % 2] if i % 5 else None) for i in range(500)]
    df = table("u int, v int, s string", data)
    got = hashrank.with_hash_rank(df, "s", ["u", "v"], 1).collect()
    again = {
        (r["u"], r["rn"]) for r in hashrank.with_hash_rank(df.repartition(7), "s", ["u", "v"], 1, digits=1).collect()
    }
    assert {(r["u"], r["rn"]) for r in got} == again
    for s in ("a", "b", None):
        part = [r for r in got if r["s"] == s]
        assert sorted(r["rn"] for r in part) == list(range(1, len(part) + 1)) and {r["n"] for r in part} == {len(part)}


@pytest.fixture
def pairs(table):
    rng = random.Random(7)
    seen = set()
    while len(seen) < 400:
        u, v = sorted(rng.sample(range(1, 5001), 2))
        seen.add((u, v))
    return table(
        "u int, v int, stratum string, lt8_any int",
        [(u, v, f"s{i % 4 + 1}", 0) for i, (u, v) in enumerate(sorted(seen))]
    )


def test_splits_are_exact_disjoint_and_repeatable(pairs):
    a = {(r["u"], r["v"]): (r["split"], r["stratum"]) for r in splits.draw_splits(pairs).collect()}
    for s in ("s1", "s2", "s3", "s4"):
        n = [x for x, st in a.values() if st == s]
        assert (n.count("test"), n.count("val"), n.count("train")) == (10, 9, 81)
    assert a == {
        (r["u"], r["v"]): (r["split"], r["stratum"]) for r in splits.draw_splits(pairs.repartition(3)).collect()
    }
    other = {(r["u"], r["v"]): (r["split"], r["stratum"]) for r in splits.draw_splits(pairs, seed=1).collect()}
    assert a != other


def test_negatives(spark, table, pairs):
    nodes = spark.range(1, 5001).select(F.col("id").cast("int").alias("id"))
    neg = [(r["u"], r["v"]) for r in splits.draw_negatives(500, nodes, pairs).collect()]
    positive = {(r["u"], r["v"]) for r in pairs.collect()}
    assert len(neg) == len(set(neg)) == 500 and all(v - u > 20 for u, v in neg) and not positive & set(neg)
    with pytest.raises(ValueError):
        splits.draw_negatives(10, spark.range(5).select(F.col("id").cast("int").alias("id")), pairs, max_rounds=2)


def test_negatives_of_a_dense_graph_are_all_there_are(spark, table):
    nodes = spark.range(40).select(F.col("id").cast("int").alias("id"))
    free = {(u, v) for u in range(40) for v in range(u + 21, 40)}
    known = table("u int, v int", sorted(free)[:100])
    left = free - set(sorted(free)[:100])
    draw = lambda n, **k: [(r["u"], r["v"], r["rn"]) for r in splits.draw_negatives(n, nodes, known, **k).collect()]
    got = draw(len(left))
    assert {(u, v) for u, v, _ in got} == left and sorted(r for *_, r in got) == list(range(1, len(left) + 1))
    assert {(u, v) for u, v, r in got if r <= 30} == {(u, v) for u, v, _ in draw(30)}
    with pytest.raises(ValueError):
        draw(len(left) + 1)
    assert len(draw(10_000, fewer=True)) == len(left)
    idx = table("id int, idx bigint", [(i, i) for i in range(300)])
    assert {tuple(r) for r in splits._enumerated(idx, 300).collect()} == {(u, v) for v in range(300) for u in range(v)}


def test_built_splits(table):
    rng = random.Random(1)
    x = table(
        X,
        [
            mention(rng.randrange(1, 300), rng.randrange(1, 300), rng.choice(["s1", "s2", "s3", "s4", None]))
            for _ in range(900)
        ]
    )
    corpus = table("a_number int, terms array<string>", [(i, [str(k) for k in range(i % 12)]) for i in range(1, 300)])
    meta = table("a_number int, keywords string", [(5, "nonn,dead"), (6, "deadly"), (7, None)])
    out = splits.build_splits(x, corpus, meta).collect()
    pos, neg = [r for r in out if r["label"] == 1], [r for r in out if r["label"] == 0]
    assert len(neg) == 5 * len(pos) and len({(r["u"], r["v"]) for r in out}) == len(out)
    for s in ("train", "val", "test"):
        assert sum(r["split"] == s for r in neg) == 5 * sum(r["split"] == s for r in pos)
    assert (
        all(r["lt8_any"] == 0 for r in neg)
        and not any(5 in (r["u"], r["v"]) or r["u"] % 12 == 0 or r["v"] % 12 == 0 for r in out)
    )
    assert all(r["lt8_any"] == int(min(r["u"] % 12, r["v"] % 12) < 8) for r in pos)
    f = splits.funnel(x, corpus, meta).first()
    assert (
        f["pairs"] == f["not_in_terms"]
        + f["touching_dead"]
        + f["unlabelled"]
        + f["eligible"]
        and f["eligible"] == len(pos)
    )
    df = splits.build_splits(x, corpus, meta)
    m = splits.manifest(df, splits.funnel(x, corpus, meta))
    assert (
        m["content"] == splits.manifest(df.repartition(5), splits.funnel(x, corpus, meta))["content"]
        and m["funnel"]["eligible"] == len(pos)
    )
    assert splits.build_splits(x.limit(0), corpus, meta).count() == 0


def test_audit(table):
    x = table(
        X, [mention(i, i + 1, f"s{i % 4 + 1}") for i in range(1, 200)] + [mention(2, 1, "s1"), mention(1, 2, None)]
    )
    nodes, names = table("id int", [(i,) for i in range(1, 150)]), table("a_number int, name string", [(1, "one")])
    s = audit.audit_sample(x, nodes, names, 10).collect()
    assert (
        len(s) == 40 and {r["stratum"] for r in s} == {"s1", "s2", "s3", "s4"} and all(r["u"] < r["v"] < 150 for r in s)
    )
    rep = {(r["u"], r["v"]): (r["source"], r["stratum"]) for r in audit.representatives(x, nodes).collect()}
    assert rep[1, 2] == (2, "s1") and len(rep) == 148
    done = table(
        "stratum string, hand_label string",
        [("s1", "s1"), ("s1", " S1"), ("s1", "s2"), ("s2", ""), ("s2", None), ("s3", "s3")]
    )
    assert {tuple(r) for r in audit.precision_report(done).collect()} == {("s1", 2, 3, 0.6667), ("s3", 1, 1, 1.0)}
    rows = audit.confusion(
        done.filter("hand_label <> ''").withColumn("hand_label", F.lower(F.trim("hand_label"))),
        "stratum",
        "hand_label",
        ["s1", "s2", "s3", "s4"]
    ).collect()
    assert {tuple(r) for r in rows} == {("s1", 2, 1, 0, 0), ("s3", 0, 0, 1, 0)}
    blind, key = audit.blind(audit.audit_sample(x, nodes, names, 10))
    assert "stratum" not in blind.columns and key.count() == 40


def test_known_pairs(table):
    rel, x = (
        table("program int, calls int", [(1, 2), (2, 1), (1, 2), (3, 3), (None, 1)]),
        table("source int, target int", [(5, 4), (4, 4), (6, None)])
    )
    assert {tuple(r) for r in exclude.known_pairs(rel, x).collect()} == {(1, 2), (4, 5)}
    left = exclude.without_known(
        table("u int, v int, n int", [(2, 1, 0), (4, 5, 1), (7, 8, 2), (None, 1, 3)]), exclude.known_pairs(rel, x)
    )
    assert [tuple(r) for r in left.collect()] == [(7, 8, 2)]
    assert tuple(exclude.relation_sizes(rel).first()) == (3, 4, 1)


def test_keyword_counts_and_coverage(table):
    meta = table(
        "a_number int, keywords string", [(1, "cons, dead"), (1, "cons"), (2, "console"), (3, None), (None, "cons")]
    )
    assert {r["keyword"]: r["n"] for r in catalog.keyword_counts(meta).collect()} == {
        "dead": 1, "cons": 1, **{k: 0 for k in ("dup", "dupe", "base", "fini", "sign", "nonn")}
    }
    full = catalog.full_catalog(
        table("a_number int, terms array<string>", [(1, ["5"]), (2, [])]),
        table("a_number int, name string", [(1, "one"), (3, "three"), (None, "x")]),
        table("a_number int, xrefs array<int>", [(1, [3]), (9, [1])])
    )
    assert {tuple(map(str, r)) for r in full.collect()} == {
        ("1", "['5']", "one", "[3]", "False"), ("2", "[]", "", "[]", "True"), ("3", "[]", "three", "[]", "True")
    }


def test_retrieval(table):
    seqs = table(
        "id int, seq array<string>",
        [(100, list("12345678")), (1, list("1234567")), (2, list("34569")), (3, list("99")), (4, list("12345678"))]
    )
    cand = retrieval.shared_gram_candidates(seqs.filter("id = 100"), seqs)
    top = {r["id"]: (r["rank"], round(r["jaccard"], 4)) for r in retrieval.top_k(cand, 2).collect()}
    assert top == {4: (1, 1.0), 1: (2, round(5 / 6, 4))}
    held = table("u int, v int, stratum string", [(1, 100, "s1"), (100, 2, "s1"), (3, 100, "s2")])
    ranks = retrieval.hit_ranks(held, retrieval.top_k(cand, 3))
    rep = {r["stratum"]: r for r in retrieval.retrieval_report(ranks).collect()}
    assert (
        (rep["s1"]["recall_1"], rep["s1"]["recall_10"], rep["s1"]["mrr"]) == (0.0, 1.0, round((1 / 2 + 1 / 3) / 2, 6))
        and rep["s2"]["mrr"] == 0
        and rep["s1"]["underpowered"]
    )
    ci = {r["stratum"]: r for r in retrieval.bootstrap_ci(ranks).collect()}
    assert 0 <= ci["s1"]["low"] <= ci["s1"]["high"] <= 1 and ci["s2"]["high"] == 0


def test_nearest_vectors_against_all(table):
    rng = random.Random(1)
    data = (
        [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(0, 400, 4)]
        + [(1, None), (3, [0.0] * 5), (None, [1.0] * 5)]
    )
    got = {}
    for r in retrieval.nearest_vectors(
        table("vec_id bigint, embedding array<double>", data), k=5, block=2, rows=30
    ).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["vec_id"]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    good = [(i, v) for i, v in data if v and i is not None and any(v)]
    assert got.keys() == {0, 100, 200, 300}
    for q, v in good:
        if q in got:
            best = sorted(((-round(cos(v, w), 9), i) for i, w in good if i != q))[:5]
            assert [i for _, i in sorted(got[q])] == [i for _, i in best]
