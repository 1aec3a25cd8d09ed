import gzip
import io
import json
import tarfile

import pytest

from termloom.operators import audit, stats
from termloom.plans import registry
from termloom.session import table as load
from termloom.sources import dumps, schemas, sinks

ENTRY = (
    "%I A000010\n%N A000010 Some name.\n%Y A000010 Cf. A000020 (complement), A000010, A1234567.\n%K A000010 nonn,easy\n%Y A000010\n%Y A000010 Duplicate of A000030.\n%K A000010 more\n"
)


def test_term_and_name_lists(spark, tmp_path):
    with gzip.open(tmp_path / "stripped.gz", "wt") as f:
        f.write(
            "# comment\nA000045 ,0,1,1,2,\nA000001 ,+1,x,,-5,\nA000002 ,\nA000003\nB000004 ,1,\nA000046 ,0,1, 1,\nA000047 ,0,1,2, \n"
        )
    (tmp_path / "names").write_text("# comment\nA000045 Fibonacci numbers: F(n). \nA12 no\n")
    assert {(r[0], tuple(r[1])) for r in dumps.read_terms(spark, str(tmp_path / "stripped.gz")).collect()} == {
        (45, ("0", "1", "1", "2")), (1, ("1", "-5")), (2, ()), (3, ()), (46, ("0", "1", "1")), (47, ("0", "1", "2"))
    }
    assert {
        tuple(r) for r in dumps.read_lengths(spark, str(tmp_path / "stripped.gz")).filter("n > 0").collect()
    } == {(45, 4), (1, 2), (46, 3), (47, 3)}
    assert [
        tuple(r) for r in dumps.read_names(spark, str(tmp_path / "names")).collect()
    ] == [(45, "Fibonacci numbers: F(n).")]


def test_entries_in_folders_and_archives(spark, tmp_path):
    (tmp_path / "seq/A000").mkdir(parents=True)
    (tmp_path / "seq/A000/A000010.seq").write_bytes(ENTRY.encode())
    (tmp_path / "seq/A000/A000011.seq").write_bytes(b"%N A000011 bad \xff byte\n%Y A000011 Cf. A000011.\n")
    (tmp_path / "seq/A000/readme.txt").write_text("%Y A000012 Cf. A000010.")
    with tarfile.open(tmp_path / "all.tar.gz", "w:gz") as tar:
        for n in ("A000010", "A000011"):
            data = (tmp_path / f"seq/A000/{n}.seq").read_bytes()
            info = tarfile.TarInfo(f"seq/A000/{n}.seq")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    for e in (
        dumps.read_entries(spark, str(tmp_path / "seq")), dumps.read_archives(spark, str(tmp_path / "all.tar.gz"))
    ):
        texts = {r["a_number"]: r["text"] for r in e.collect()}
        assert texts.keys() == {10, 11} and "bad � byte" in texts[11]
        got = {
            (r["source"], r["target"], r["y_line_idx"], r["link_type"], r["paren"])
            for r in dumps.entry_mentions(e).collect()
        }
        assert got == {
            (10, 20, 0, "transform", "complement"), (10, 1234567, 0, "transform", ""), (10, 30, 2, "duplicate", "")
        }
        assert {tuple(r) for r in dumps.entry_meta(e).collect()} == {(10, "nonn,easy,more", 3), (11, "", 1)}
        assert [(r[0], r[1]) for r in dumps.entry_references(e).collect()] == [(10, [20, 30, 1234567])]


def test_programs_and_json(spark, tmp_path, table):
    (tmp_path / "000").mkdir()
    (tmp_path / "000/A000010.asm").write_text("; A000010\n  seq $1,45\n\tseq $12 , 000142\n; seq $1,999\nmov $1,3\n")
    (tmp_path / "000/notes.asm").write_text("seq $1,7\n")
    assert {
        tuple(r) for r in dumps.program_calls(dumps.read_programs(spark, str(tmp_path))).collect()
    } == {(10, 45), (10, 142)}
    (tmp_path / "000/A000045.json").write_text(json.dumps({"x": ["A000045", {"y": "see A000032, A000142"}]}))
    assert {
        r["ref"] for r in dumps.json_mentions(dumps.read_json_documents(spark, str(tmp_path))).collect()
    } == {45, 32, 142}
    paths = table("path string", [("x/b000045.txt",), ("x/a000046.txt",), (None,), ("y/b000045.txt",)])
    assert [r["id"] for r in dumps.listed_ids(paths).collect()] == [45]


def test_audit_round_trip(spark, tmp_path, table):
    sample = table(
        "u int, v int, source int, target int, stratum string, link_type string, paren string, raw_text string, name_source string, name_target string, hand_label string",
        [
            (1, 2, 2, 1, "s1", "Cf.", "", 'say "x",\nthen y', "a", "", "s1"),
            (3, 4, 3, 4, "s2", "Cf.", "p", "t", "", "", "s3")
        ]
    )
    sinks.write_blind_audit(sample, str(tmp_path / "audit"))
    back = dumps.read_audit(spark, str(tmp_path / "audit/blind"), str(tmp_path / "audit/key"))
    rows = {r["u"]: r for r in back.collect()}
    assert rows[1]["raw_text"] == 'say "x",\nthen y' and rows[1]["stratum"] == "s1"
    assert {r["stratum"]: r["correct"] for r in audit.precision_report(back).collect()} == {"s1": 1, "s2": 0}


def test_sinks(spark, tmp_path, table):
    df, at = table("a_number int, n int", [(2, 1), (1, 5)]), str(tmp_path)
    sinks.write_table(df, f"{at}/t")
    sinks.write_table(df.limit(1), f"{at}/t")  # kept as it is
    assert spark.read.parquet(f"{at}/t").count() == 2
    sinks.write_table(df.limit(1), f"{at}/t", force=True)
    assert spark.read.parquet(f"{at}/t").count() == 1
    sinks.write_json_lines(df.coalesce(1), f"{at}/j")
    assert [r["a_number"] for r in spark.read.json(f"{at}/j").collect()] == [1, 2]
    sinks.write_id_list(table("id int", [(45,), (1234567,), (45,)]), f"{at}/ids")
    assert [r[0] for r in spark.read.text(f"{at}/ids").collect()] == ["A000045", "A1234567"]
    assert (
        sinks.write_report(spark, f"{at}/r.json", {"a": 1})
        and not sinks.write_report(spark, f"{at}/r.json", {}, force=False)
    )
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}
    sinks.append_log(spark, f"{at}/log", "one")
    sinks.append_log(spark, f"{at}/log", "two")
    assert sorted(r[0].split(" ", 1)[1] for r in spark.read.text(f"{at}/log").collect()) == ["one", "two"]
    sinks.require(spark, f"{at}/r.json")
    with pytest.raises(FileNotFoundError):
        sinks.require(spark, f"{at}/no.lock")
    assert [f.name for f in schemas.XREFS] == [
        "source", "target", "y_line_idx", "link_type", "paren", "raw_text", "stratum"
    ]


def test_statistics_report(spark):
    d = "/root/testdata/sf0.001"
    s = stats.statistics(*(load(spark, d, t) for t in ("corpus", "xrefs", "seq_meta", "relations")))
    assert (
        s["mentions"]["stored"] == 1000
        and s["degrees"][0]["kind"] == "in_deg"
        and "## degrees" in sinks.markdown(s, "Statistics")
    )
    assert stats.statistics_table(s, spark).count() > 50


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0
