import random

import pytest

from termloom.llm import leakage, sets

SCHEMA = "a_number int, terms array<string>, n int, id string, ckey int"


def clean(ts):
    out = set()
    for t in ts or []:
        try:
            if t is not None and "_" not in t:
                out.add(int(t))
        except ValueError:
            pass
    return out


def brute(records, threshold=0.6):
    good = [(i, s) for i, s in records if i is not None and len(s) >= 8]
    return {
        (min(a, b), max(a, b))
        for a, x in good
        for b, y in good
        if a < b
        and 10 * len(x & y) >= round(10 * threshold) * len(x | y)
    }


def rows(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [
            str(rng.choice([0, 1, 2, 3]) if rng.random() < 0.3 else rng.randrange(60))
            for _ in range(rng.choice([0, 5, 9, 14, 25]))
        ]
        if i % 3 == 0 and out:
            base = list(rng.choice(out)[1] or [])
            for _ in range(rng.randrange(4)):
                base.append(str(rng.randrange(900)))
        out.append((i, base))
    return out


@pytest.mark.parametrize("block", [3, 2000])
def test_against_all_pairs(table, spark, monkeypatch, block):
    data = rows(5)
    # every spelling of the same number, and what is no number
    data += [
        (900, ["+1", "01", " 2 ", "\t3", "4", "5", "6", "7", "8", "-0", None, "", "?", "1.5"]),
        (901, ["0", "1", "2", "3", "4", "5", "6", "7", "8", "0008"])
    ]
    corpus = table("a_number int, terms array<string>", data + [(None, data[0][1]), (77777, None)])
    subs = table("sub_id bigint, terms array<string>", [(10_000 + i, t) for i, t in data[:20]] * 2)
    members, classes = sets.set_classes(
        corpus.selectExpr("cast(a_number as bigint) id", "terms").unionByName(subs.selectExpr("sub_id id", "terms")),
        "id",
        "terms"
    )
    pairs = sets.similar_classes(classes, 0.6, block)
    want = brute([(i, clean(t)) for i, t in data] + [(10_000 + i, clean(t)) for i, t in data[:20]])
    got = [tuple(r) for r in sets.record_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (900, 901) in want


def test_one_record_stored_with_two_lists_and_clashing_columns(table):
    a, b = [str(i) for i in range(10)], [str(i) for i in range(50, 60)]
    c = table(SCHEMA, [(1, a, 0, "x", 0), (1, b, 0, "x", 0), (2, b, 0, "x", 0), (3, a, 0, "y", 1)])
    s = table("sub_id bigint, terms array<string>", [])
    members, classes, pairs = sets.similar_records(c, s)
    assert {tuple(r) for r in sets.record_pairs(members, pairs).collect()} == {(1, 2), (1, 3)}


def test_copies_are_counted_not_spelled_out(table):
    a = [str(i) for i in range(10)]
    c = table(
        "a_number int, terms array<string>", [(i, a) for i in range(1, 31)] + [(50, a[:9] + ["99"]), (60, ["7"] * 9)]
    )
    members, classes, pairs = sets.similar_records(c, table("sub_id bigint, terms array<string>", []))
    links = {
        r["id"]: (r["class_id"], r["copies"], r["links"])
        for r in sets.links_per_record(members, classes, pairs).collect()
    }
    assert pairs.count() == 1 and links[1] == (1, 30, 30) and links[50] == (50, 1, 30) and 60 not in links


def test_nothing(table):
    out = sets.similar_records(table("a_number int, terms array<string>"), table("sub_id bigint, terms array<string>"))
    assert sets.record_pairs(out[0], out[2]).count() == 0


def test_leaks_across_splits(table):
    rng = random.Random(9)
    data = rows(11)
    corpus = table("a_number int, terms array<string>, split string", [(*r, "x") for r in data])
    splits = (
        [
            (
                rng.randrange(130),
                rng.randrange(130),
                rng.choice(["train", " Train", "val", "test", None]),
                rng.choice(["s1", "S1 ", None])
            )
            for _ in range(400)
        ]
        + [(None, 3, "train", "s1"), (4, None, "val", "s1")]
    )
    near = brute([(i, clean(t)) for i, t in data])
    near |= {(b, a) for a, b in near} | {(i, i) for i in range(130)}
    train = {(u, v) for u, v, s, _ in splits if s and s.strip().lower() == "train" and u is not None and v is not None}
    train |= {(v, u) for u, v in train}
    want = set()
    for u, v, s, _ in splits:
        if s in ("val", "test") and u is not None and v is not None and any(
            (a, b) in train for a in range(130) if (u, a) in near for b in range(130) if (v, b) in near
        ):
            want.add((s, min(u, v), max(u, v)))
    table_ = table("u int, v int, split string, stratum string", splits)
    got = leakage.cross_split_overlaps(table_, corpus)
    found = {tuple(r) for r in got.select("split", "u", "v").collect()}
    assert found == want and got.filter("exact").count() == len({w for w in want if (w[1], w[2]) in train})
    report = {(r["split"], r["stratum"]): r for r in leakage.overlap_report(table_, got).collect()}
    assert sum(r["exact"] + r["near"] for r in report.values()) >= len(want)
    assert leakage.cross_split_overlaps(table_.limit(0), corpus).count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_of_large_classes_come_from_blocks(table, block):
    from termloom.llm.copies import spelled_pairs

    rng = random.Random(6)
    cid = {i: 1 if i % 2 else rng.choice([2, 3, 4, 5]) for i in range(120)}  # one class has half of all records
    size = {c: list(cid.values()).count(c) for c in range(1, 6)}
    members = table("id bigint, cid bigint, copies bigint", [(i, c, size[c]) for i, c in cid.items()])
    linked = {(1, 2), (3, 4)}
    out = spelled_pairs(members, table("cid_1 bigint, cid_2 bigint, overlap int", [(*x, 1) for x in linked]), block)
    got = [tuple(r) for r in out.collect()]
    want = {
        (i, j)
        for i in cid
        for j in cid
        if i < j
        and (cid[i] == cid[j] or (cid[i], cid[j]) in linked or (cid[j], cid[i]) in linked)
    }
    assert len(got) == len(set(got)) and set(got) == want
    assert out.rdd.getNumPartitions() >= 4


def test_token_of_nearly_every_set(table):
    rng = random.Random(12)
    data = [(i, ["0", "1"] + [str(x) for x in rng.sample(range(2, 40), 10)]) for i in range(150)]
    classes = table("cid bigint, toks string, n int", [(i, ",".join(t), len(t)) for i, t in data])
    got = {(r["cid_1"], r["cid_2"]) for r in sets.similar_classes(classes, 0.6, 10).collect()}
    assert got == brute([(i, clean(t)) for i, t in data]) and got
