"""Folders of files, archives and reports."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylink.operators import match
from quarrylink.sources import io, scratch

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def raw(tmp_path):
    for part, stem, line in (("train", "source1", "S1-1\tNA\t\tus\n"), ("train", "source2", "S2-1\tb\tx \"y\" st\tus\n"), ("test", "source1", "S1-9\tc\t\t\n")):
        (tmp_path / "raw" / part).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / part / f"{stem}.tsv").write_text(HEAD + line)
    (tmp_path / "raw" / "notes.txt").write_text("no table")
    return str(tmp_path / "raw")


def test_raw_tree_is_converted(spark, tmp_path):
    folder = raw(tmp_path)
    rows = {(r["split"], r["stem"], r["entity_id"], r["business_name"], r["business_address"]) for r in io.read_raw_tree(spark, folder).collect()}
    assert rows == {("train", "source1", "S1-1", "NA", None), ("train", "source2", "S2-1", "b", 'x "y" st'), ("test", "source1", "S1-9", "c", None)}
    io.convert_tree(spark, folder, str(tmp_path / "out"))
    got = {(r["split"], r["stem"], r["entity_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {x[:3] for x in rows}


def test_files_are_discovered(spark, tmp_path):
    folder = raw(tmp_path)
    found = [p.rsplit("/raw/")[1] for p in io.discover(spark, folder, "source1", ".tsv")]
    assert found == ["test/source1.tsv", "train/source1.tsv"]


def test_lists_keep_the_order_given(spark, tmp_path):
    rows = spark.createDataFrame([(2, "S1-b", "S2-1,S3-2"), (1, "S1-c", None), (3, "S1-a", "")], "place int, source1_entity_id string, matched_entity_ids string")
    paths = [str(tmp_path / x) for x in ("one", "two")]
    io.write_lists(rows, *paths, order_col="place", one_file=True)
    for path in paths:
        (part,) = (tmp_path / path).glob("part-*")
        assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-c\t\nS1-b\tS2-1,S3-2\nS1-a\t\n"


def test_errors_of_one_json_list(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"query": "é", "true_matches": ["a"], "tfidf_preds": [], "ce_preds": ["b", "c"]}, {"query": "q"}]')
    got = io.read_errors(spark, str(tmp_path / "e.json")).collect()
    assert [(r["query"], r["true_matches"], r["ce_preds"]) for r in got] == [("é", ["a"], ["b", "c"]), ("q", None, None)]


def test_archive_and_report(spark, tmp_path):
    (tmp_path / "result").mkdir()
    (tmp_path / "result" / "a.tsv").write_text("x")
    io.pack(str(tmp_path / "result"), str(tmp_path / "r.zip"))
    assert zipfile.ZipFile(tmp_path / "r.zip").namelist() == ["a.tsv"]
    df = spark.createDataFrame([("é", 0.5, ["a"])], "name string, score double, ids array<string>")
    assert io.markdown(df, "T") == '# T\n\n| name | score | ids |\n| --- | --- | --- |\n| é | 0.5 | ["a"] |\n'


def test_importances_and_weights(spark):
    rows = spark.range(200).selectExpr("concat('q', id) AS query_id", "CAST(id % 4 = 0 AS INT) AS label", "CAST(id % 4 = 0 AS DOUBLE) AS x", "id * 0.0 AS y")
    weighted = match.class_weight(rows)
    assert {(r["label"], r["weight"]) for r in weighted.select("label", "weight").distinct().collect()} == {(0, 1.0), (1, 1.5)}
    model = match.train(weighted, ["x", "y"], trees=2, weight="weight")
    assert [n for n, _ in match.importances(model, ["x", "y"])] == ["x", "y"]


def test_written_tables_are_deleted(spark):
    before = set(scratch.PATHS)
    df = scratch.written(spark.range(3), "some", rows=3)
    (path,) = scratch.PATHS - before
    assert df.count() == 3 and io.exists(spark, path)
    scratch.delete(spark, {path})
    assert not io.exists(spark, path) and scratch.PATHS == before


def test_result_files(spark, tmp_path):
    from quarrylink.operators import validate

    (tmp_path / "need.tsv").write_text("entity_id\tname\nS1-1\tx\nS1-2\ty\n")
    need, header = str(tmp_path / "need.tsv"), "source1_entity_id\tmatched_entity_ids\n"

    def found(data, **others):
        path = tmp_path / "m.tsv"
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        report = validate.validate_files(spark, str(path), others.get("candidate"), need, others.get("valid"))
        return {(r["level"][0], r["file"][0], r["rule"], r["n"]) for r in report.collect()} - {("w", "m", "ids_not_checked", 1)}, validate.passes(report)

    assert found(header + "S1-1\tS2-1,S3-1\r\nS1-2\t \n\n") == (set(), True)
    assert found("") == ({("e", "m", "empty_file", 1)}, False)
    assert found(header.replace("\t", ",")) == ({("e", "m", "comma_separated", 1)}, False)
    assert found("a\tb\n") == ({("e", "m", "unexpected_header", 1)}, False)
    assert found(header + "S1-1\tS2-1, S2-2,\nS1-2\t\n")[0] == {("e", "m", "bad_prefix", 2)}
    # Only the first line is the header.
    assert found(header + header + "S1-1\t\nS1-2\t\n")[0] == {("e", "m", "extra_row", 1), ("e", "m", "bad_prefix", 1)}
    assert found(header.encode() + b"S1-1\t\nS1-2\t\nx\xff\n")[0] == {("e", "m", "malformed_row", 1), ("e", "m", "not_utf8", 1)}
    assert found(header + "S1-1\t\nS1-2\t\n", candidate=str(tmp_path / "none.tsv")) == ({("w", "c", "file_not_found", 1)}, True)
    assert not validate.passes(validate.validate_files(spark, str(tmp_path / "none.tsv"), None, need))
    assert [r["file"] for r in validate.validate_files(spark, need, None, str(tmp_path / "none.tsv")).collect()] == ["required"]


def test_a_table_whose_writing_failed_is_made_anew(spark, tmp_path):
    failing = lambda: spark.range(1).select(F.raise_error(F.lit("no room")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no room"):
        scratch.once(spark, "once-test", str(tmp_path), failing)
    assert scratch.once(spark, "once-test", str(tmp_path), lambda: spark.range(3)).count() == 3
