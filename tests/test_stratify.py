import pytest
from pyspark.sql import functions as F

from termloom.functions import ids, text
from termloom.operators import stratify

NAMES = [
    (1, "Tribonacci numbers."),
    (2, "First differences of A000213, also twice A000001."),
    (3, "Numbers whose runs-resistance is maximal."),
    (4, "Decimal expansion of 4 - Pi."),
    (5, "Positions of 0 in A000007; complement of A000006."),
    (6, "Positions of 1 in A000007."),
    (9, "Duplicate of A000003."),
]
CLUSTER = (
    "The following sequences are all essentially the same, with A000031 as the parent: A000031, A000032 (s(n)-1), A000033 (s(n)-2). The first differences of A000031 essentially matches A000061."
)
CASES = [
    (10, "Cf. A000020 (essentially the same).", 20, "essentially the same", "s1"),
    (10, "Cf. A000011, A000012; essentially the same as A000013.", 13, "", "s1"),
    (10, "Cf. A000011, A000012; essentially the same as A000013.", 11, "", "s3"),
    (10, "Cf. A000030, A000031. Essentially the same as A000096.", 30, "", "s3"),
    (10, "Cf. A000030, A000031. Essentially the same as A000096.", 31, "", "s3"),
    (10, "Cf. A000030, A000031. Essentially the same as A000096.", 96, "", "s1"),
    (10, "Essentially the same as row sums of A000128.", 128, "", "s3"),
    (31, CLUSTER, 32, "", "s1"),
    (31, CLUSTER, 61, "", "s2"),
    (9, "Cf. A000003.", 3, "", "s1"),
    (3, "Cf. A000009.", 9, "", "s1"),
    (10, "Cf. A000022 (complement).", 22, "complement", "s2"),
    (10, "Partial sums: A000023.", 23, "", "s2"), (10, "First differences are in A000024.", 24, "", "s2"),
    (10, "The case of partitions is A000041, complement A000042.", 41, "", "s3"),
    (10, "The case of partitions is A000041, complement A000042.", 42, "", "s3"),
    (10, "Cf. A000050, A000051 (partial sums).", 50, "", "s3"),
    (10, "Cf. A000050, A000051 (partial sums).", 51, "partial sums", "s2"),
    (2, "Cf. A000001.", 1, "", "s2"), (1, "Cf. A000002.", 2, "", "s2"), (5, "Cf. A000006.", 6, "", "s2"),
    (10, "Cf. A000004.", 4, "", "s4"),
    (10, "Essentially the same as A000004.", 4, "", "s1"),
    (10, "Cf. A000077, A000078.", 77, "", "s3"),
    (10, "MÖBIUS TRANSFORM of A000079.", 79, None, "s2"), (10, None, 80, None, "s3"),
]


def test_rules(table):
    mentions = table("source int, raw_text string, target int, paren string, want string", CASES)
    rated = stratify.stratum_v1(
        mentions, table("a_number int, name string", NAMES), table("a_number int, keywords string")
    )
    rows = rated.collect()
    assert len(rows) == len(CASES)
    assert [
        (r["source"], r["raw_text"], r["target"], r["stratum_v1"]) for r in rows if r["stratum_v1"] != r["want"]
    ] == []


def test_draft_rules(table):
    names, meta = (
        table("a_number int, name string", [*NAMES, (80, "Continued fraction expansion of e.")]),
        table("a_number int, keywords string", [(70, "core,cons"), (71, "constant"), (None, "cons")])
    )
    cases = [
        (10, "Duplicate of A000020.", 20, "", "s1"),
        (9, "Cf. A000003.", 3, "", "s1"),
        (10, "Cf. A000022 (complement).", 22, "complement", "s2"),
        (10, "Cf. A000070.", 70, "", "s4"),
        (10, "Cf. A000071.", 71, "", "s3"),
        (10, "Partial sums of A000023.", 23, "", "s2"),
        (10, "Partial sums of A000023, A000024, A000025, A000026.", 24, "", "s3"),
        (80, "Cf. A000072.", 72, None, "s4"),
        (10, "Negated A000023.", 23, "", "s3"),
    ]
    got = stratify.stratum_v0(
        table("source int, raw_text string, target int, paren string, want string", cases), names, meta
    ).collect()
    assert len(got) == len(cases) and [r for r in got if r["stratum_v0"] != r["want"]] == []


def test_constants(table):
    names, meta = (
        table("a_number int, name string", NAMES),
        table("a_number int, keywords string", [(70, "core, cons"), (72, " cons,easy"), (73, "constant"), (74, None)])
    )
    ids_of = lambda v: {r["id"] for r in stratify.constant_like(names, meta, v).collect()}
    assert ids_of(0) == {4, 70, 72} and ids_of(1) == {4, 72}


@pytest.mark.parametrize("raw,want", [
    (
        "A001690 (complement), A001622(phi) A000032 (see A000045) A12345678",
        [(1690, "complement"), (1622, "phi"), (32, ""), (45, ""), (1234567, "")]
    ),
    ("none", []), ("", []), (None, None), ("A000001 (" + "x" * 121 + ")", [(1, "")]), ("A000001 (a (b))", [(1, "")]),
])
def test_mentions(table, raw, want):
    got = table("t string", [(raw,)]).select(text.mentions(F.col("t")).alias("m")).first()["m"]
    assert got is None and want is None or [tuple(m) for m in got] == want


def test_helpers(table):
    one = lambda s, f: table("t string", [(s,)]).select(f(F.col("t")).alias("x")).first()["x"]
    assert len(one("Partial sums give A000001. a(n) = A000002(n, 0).", text.sentences)) == 2
    assert "x" not in one("a (x (y) z) b", text.strip_parens)
    assert [
        one(s, text.line_type)
        for s in ("Cf. A1", "See also A1", "cfr", "Duplicate of A000001", "Cf. bisection", "Row 3")
    ] == ["Cf.", "See also", "other", "duplicate", "transform", "other"]
    assert one(" a,b ,,a", text.keyword_list) == ["a", "b"] and one(None, text.keyword_list) == []
    assert [
        one(s, ids.parse_id) for s in (" A000045 ", "A45", "A12345678", "a000045", None)
    ] == [45, None, None, None, None]
    assert [
        table("n int", [(n,)]).select(ids.format_id(F.col("n")).alias("x")).first()["x"] for n in (45, 1234567, None)
    ] == ["A000045", "A1234567", None]
