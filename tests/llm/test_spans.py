import random

import pytest

from termloom.llm import spans


def grams(seq, k):
    return {tuple(seq[i : i + k]): 1 for i in range(len(seq) - k + 1)}


@pytest.mark.parametrize("block", [2, 2000])
def test_runs_against_all_windows(table, block):
    rng = random.Random(4)
    data, k = [], 12
    for i in range(60):
        s = [rng.randrange(40) for _ in range(rng.choice([0, 11, 12, 13, 40, 90]))]
        if i % 2 and data:
            other = rng.choice(data)[1]
            at = rng.randrange(max(1, len(other) - 11))
            s = s[: rng.randrange(9)] + other[at : at + rng.choice([11, 12, 13, 30])] + s[5:]
        if i % 7 == 0:
            s = s[:5] + [0] * rng.choice([11, 12, 14, 20]) + s[:3]  # one repeated number
        data.append((i, s))
    data += [(100, data[1][1]), (101, data[1][1])]
    corpus = table(
        "a_number int, terms array<string>, cid int, h int",
        [(i, [str(x) for x in s], 1, 1) for i, s in data] + [(None, ["1"] * 20, 1, 1), (200, None, 1, 1)]
    )
    want = {(a, b) for a, x in data for b, y in data if a < b and grams(x, k).keys() & grams(y, k).keys()}
    members, classes = spans.sequence_classes(corpus)
    runs = spans.shared_runs(classes, block=block).collect()
    assert len(runs) == len(set(runs))
    seqs = {r["cid"]: r["seq"].split(",") for r in classes.collect()}
    for r in runs:  # equal, and maximal
        a, b, i, j, n = seqs[r.cid_1], seqs[r.cid_2], r.start_1, r.start_2, r.len
        assert n >= k and a[i : i + n] == b[j : j + n]
        assert i == 0 or j == 0 or a[i - 1] != b[j - 1]
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]
    got = [tuple(r) for r in spans.run_pairs(corpus).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    cover = {r["a_number"]: r for r in spans.coverage(corpus).collect()}
    for i, s in data:
        if len(s) < k:
            assert i not in cover
            continue
        others = set().union(*(grams(y, k).keys() for j, y in data if j != i))
        held = set().union(*(range(p, p + k) for p in range(len(s) - k + 1) if tuple(s[p : p + k]) in others), set())
        assert (cover[i]["covered"], cover[i]["partners"]) == (len(held), sum(i in p for p in want))


def test_what_is_no_number_interrupts_nothing(table):
    s = [str(i * i) for i in range(14)]
    dirty = [x for t in s for x in (t, None, " ", "?")]
    corpus = table(
        "a_number int, terms array<string>", [(1, s), (2, ["+" + t for t in s]), (3, dirty), (3, dirty), (4, s[:11])]
    )
    assert {tuple(r) for r in spans.run_pairs(corpus).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_nothing(table):
    assert spans.run_pairs(table("a_number int, terms array<string>")).count() == 0
    assert spans.coverage(table("a_number int, terms array<string>")).count() == 0


def test_runs_and_records_of_a_folder(spark, table, tmp_path):
    import __spark_entry__ as entry

    run = [str(x) for x in range(1000, 1015)]
    rows = [(1, [*"123", *run, "7"]), (2, [*"123", *run, "7"]), (3, [*run, "8"]), (4, ["1", "x"]), (5, []), (6, None)]
    table("a_number int, terms array<string>", rows).write.parquet(f"{tmp_path}/corpus.parquet")
    q = entry.queries()
    (r,) = q["p2_runs"](spark, str(tmp_path)).collect()
    assert (r["len"], {(r["class_1"], r["start_1"]), (r["class_2"], r["start_2"])}) == (15, {(1, 3), (3, 0)})
    assert {tuple(r) for r in q["p2_classes"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 3)}
    got = {
        r["a_number"]: (r["class_id"], r["n_terms"], r["copies"], r["partners"], r["runs"], r["covered"])
        for r in q["p2_records"](spark, str(tmp_path)).collect()
    }
    assert got == {
        1: (1, 19, 2, 2, 1, 19),
        2: (1, 19, 2, 2, 1, 19),
        3: (3, 16, 1, 2, 1, 15),
        4: (None, 1, 0, 0, 0, 0),
        5: (None, 0, 0, 0, 0, 0),
        6: (None, 0, 0, 0, 0, 0)
    }
