"""Every query of p2 to p8 on awkward tables: empty, null everywhere, stored twice, with columns of clashing names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from termloom.llm.queries import QUERIES

RNG = random.Random(3)
WORDS = [f"{a}{b}" for a in ("valve", "pump", "rotor", "shaft", "gear") for b in ("ing", "ed", "s", "er", "")]

#: Columns that the operators use inside.
CLASHING = (
    "id",
    "key",
    "cid",
    "rid",
    "n",
    "h",
    "x",
    "t",
    "toks",
    "seq",
    "copies",
    "label_",
    "tokens",
    "q",
    "rate",
    "cell",
    "part",
    "item",
    "piece",
    "words",
    "node",
    "_b",
    "_c",
    "i",
    "exact"
)

TYPES = {
    "corpus": {"a_number": pa.int32(), "terms": pa.list_(pa.string()), "name": pa.string()},
    "submissions": {"sub_id": pa.int64(), "terms": pa.list_(pa.string()), "contributor": pa.string()},
    "splits": {"u": pa.int32(), "v": pa.int32(), "stratum": pa.string(), "label": pa.int8(), "split": pa.string()},
    "xrefs": {"source": pa.int32(), "target": pa.int32(), "stratum": pa.string()},
    "documents": {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string()},
    "eval_items": {"item_id": pa.int64(), "split": pa.string(), "kind": pa.string(), "text": pa.string()},
    "mix_targets": {"source": pa.string(), "target_share": pa.float64(), "max_repeats": pa.int32()},
}


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def tables():
    base = [str(RNG.randrange(10**6)) for _ in range(40)]
    huge = [str(10**30 + i) for i in range(20)]
    corpus = [
        (1, base),
        (2, base),
        (3, base[:30] + ["7", None, "", "?"]),
        (4, ["+" + base[0], *base[1:25]]),
        (5, huge),
        (6, ["0"] * 300),
        (7, []),
        (8, None),
        (9, ["x", None]),
        (None, base)
    ]
    corpus += [(100 + i, [str(RNG.randrange(50)) for _ in range(25)]) for i in range(20)]
    item = prose(40)
    documents = [
        (1, "Intro. " + item + ". End.", "a"),
        (2, item.upper().replace(" ", " \n"), "A "),
        (3, None, "a"),
        (4, "", "b"),
        (5, prose(6000), "b"),
        (6, "  ", None),
        (7, "弁" * 9000, "nowhere")
    ]
    documents += [(20 + i, prose(60), "a" if i % 3 else "b") for i in range(12)]
    return {
        "corpus": [(a, t, None) for a, t in corpus],
        "submissions": [(10**6, base[:38], None), (10**6 + 1, None, "c"), (None, base, "c")],
        "splits": [
            (1, 100, "s1", 1, "train"),
            (100, 2, "S1 ", 1, "val"),
            (3, 100, None, None, "test"),
            (5, 6, "s2", 0, "val"),
            (5, 6, "s3", 1, "val"),
            (None, 1, "s1", 1, "train"),
            (1, 1, "s1", 1, None)
        ],
        "xrefs": [
            (1, 2, "s1"),
            (2, 3, " S1"),
            (4, 4, "s1"),
            (5, None, "s1"),
            (None, 5, "s1"),
            (7, 8, "s2"),
            (9, 8, None),
            (50, 40, "s1")
        ],
        "documents": documents,
        "eval_items": [
            (1, "test", None, item),
            (2, "val", "k", None),
            (3, None, "k", ""),
            (None, "val", "k", item),
            (4, "val", "k", prose(40))
        ],
        "mix_targets": [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, None), (None, None, None)],
    }


def write(folder, rows, extra=()):
    for name, kinds in TYPES.items():
        cols = {c: pa.array([r[i] for r in rows[name]], k) for i, (c, k) in enumerate(kinds.items())}
        clash = {
            c: pa.array([None if i % 3 else f"clash {i}" for i in range(len(rows[name]))], pa.string())
            for c in extra
            if c not in cols
        }
        pq.write_table(pa.table(cols | clash), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    at = lambda name: tmp_path_factory.mktemp(name)
    rows = tables()
    nulls = {k: [(None,) * len(TYPES[k])] * 2 for k in rows}
    return {
        "plain": write(at("plain"), rows),
        "clash": write(at("clash"), rows, CLASHING),
        "twice": write(at("twice"), {k: r + nulls[k] + r for k, r in rows.items()}, CLASHING),
        "empty": write(at("empty"), {k: [] for k in rows}),
        "nulls": write(at("nulls"), nulls),
    }


def result(spark, folder, name):
    df = QUERIES[name](spark, folder)
    return df.columns, sorted(map(str, df.collect()))


FOUND = sorted(n for n in QUERIES if n.endswith("_found"))


@pytest.mark.parametrize("name", FOUND)
def test_repeated_and_null_rows_and_clashing_columns_change_nothing(spark, folders, name):
    columns, plain = result(spark, folders["plain"], name)
    assert plain and result(spark, folders["twice"], name) == (columns, plain)
    assert result(spark, folders["nulls"], name) == (columns, [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(FOUND)))
def test_reports_of_awkward_tables(spark, folders, name):
    columns, rows = result(spark, folders["clash"], name)
    assert rows and result(spark, folders["empty"], name)[0] == columns


def test_what_comes_out(spark, folders):
    rows = lambda name: {tuple(r) for r in QUERIES[name](spark, folders["plain"]).collect()}
    assert {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)} == {p for p in rows("p2_found") if p[1] < 100}
    assert {(1, 2), (1, 3), (1, 10**6), (2, 10**6)} <= rows("p3_found")
    assert rows("p4_found") == {("val", 2, 100), ("test", 3, 100)}
    assert rows("p5_found") == {(1, 1), (1, 2), (1, 3), (40, 40), (40, 50)}
    assert rows("p6_found") == {(1, 1), (1, 2)}
    assert rows("p8_found") == {(5,), (7,)}
