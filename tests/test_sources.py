"""Readers, index parsing, sinks, audits and row offsets."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from filingscope import schemas
from filingscope.functions.ordered import broadcast_if_small, with_previous
from filingscope.operators import audit
from filingscope.sources import filings as fl
from filingscope.sources import index as ix
from filingscope.sources import tables as tb

HEADER = "CIK|Company Name|Form Type|Date Filed|Filename\n------\n"


def test_index_files(spark, tmp_path):
    (tmp_path / "a.idx").write_text("Top|1|2|3|4\n" + HEADER + "1|Acme|10-K|2006-01-02|e/1.txt\n1|b\nplain\n2|B|8-K|2006-01-03|e/2.txt\n")
    (tmp_path / "b.idx").write_text("1|x|10-K|2006-01-02|f\n")
    (tmp_path / "c.idx").write_text("")
    files = ix.read_index_files(spark, [str(tmp_path)])
    strict = ix.parse_index(files).orderBy("line_no").collect()
    assert [(r.source_file, r.line_no, r.cik, r.form_type) for r in strict] == [("a.idx", 4, "1", "10-K"), ("a.idx", 7, "2", "8-K")]
    assert ix.parse_index(files, strict=False).count() == 4
    assert [(r.line_no, r.line) for r in ix.index_rejects(files).collect()] == [(5, "1|b")]


def test_first_of_block_across_files(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "y"), ("b", 2, None), ("c", 1, None), ("c", 9, "y")]
    df = spark.createDataFrame(rows, "source_file STRING, line_no INT, cik STRING")
    kept = [(r.source_file, r.line_no) for r in ix.first_of_each_block(df).orderBy("source_file", "line_no").collect()]
    assert kept == [("a", 1), ("a", 3), ("b", 2), ("c", 9)]


def test_previous_row_across_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o")).repartition(7)
    linked = with_previous(df, ["k"], ["o"], ["o"], F.floor(F.col("o") / 10), "p")
    assert linked.filter(~F.col("p.o").eqNullSafe(F.when(F.col("o") >= 3, F.col("o") - 3))).count() == 0
    sparse = with_previous(df.filter("o % 97 = 0"), ["k"], ["o"], ["o"], F.floor(F.col("o") / 10), "p")
    assert sparse.filter("p IS NULL").count() == 3


def test_broadcast_only_below_the_limit(spark):
    big, small = spark.range(100), spark.range(5)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(small, 10)) and "broadcast" not in plan(broadcast_if_small(big, 10))


def test_filing_tree(spark, tmp_path):
    for cik, accession in (("12", "0000000012-06-000001"), ("0000000034", "0000000034-99-000002")):
        folder = tmp_path / cik / "10-K" / accession
        folder.mkdir(parents=True)
        (folder / "full-submission.txt").write_text(f"line 1\nline 2 {cik}")
        (folder / "notes.md").write_text("no")
    raw = fl.read_filings(spark, str(tmp_path))
    rows = raw.orderBy("cik").collect()
    assert [(r.cik, r.form, r.accession) for r in rows] == [("0000000012", "10-K", "0000000012-06-000001"), ("0000000034", "10-K", "0000000034-99-000002")]
    assert rows[0].body == "line 1\nline 2 12"
    assert [r.cik for r in fl.from_year(raw).collect()] == ["0000000012"]
    assert fl.bad_accessions(raw.withColumn("accession", F.lit("x"))).count() == 2


def test_latest_filings_limit_before_the_shuffle(spark):
    rows = [("a", f"{i:03d}", datetime.date(2006 + i % 5, 1, 1)) for i in range(40)] + [("b", "1", datetime.date(2006, 1, 1))]
    df = spark.createDataFrame(rows, "cik STRING, accession STRING, filed_date DATE")
    latest = fl.latest_filings(df, 3)
    assert sorted(r.accession for r in latest.filter("cik = 'a'").collect()) == ["029", "034", "039"]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial") and "WindowGroupLimit" in plan


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text("cik,company_name,date,ret\n12,A,2006-01-31,0.5\n13,B,2006-02-28,NaN\n14,C,2006-03-31,\n")
    rows = tb.read_csv(spark, str(tmp_path / "r.csv"), schemas.RETURNS)
    assert [(r.cik, r.ret) for r in rows.orderBy("cik").collect()] == [("0000000012", 0.5), ("0000000013", None), ("0000000014", None)]
    tb.write_csv(rows, str(tmp_path / "out"))
    assert sorted(tb.read_csv(spark, str(tmp_path / "out"), schemas.RETURNS).collect(), key=str) == sorted(rows.collect(), key=str)
    tb.write_parquet(rows, str(tmp_path / "pq"))
    assert tb.read_parquet(spark, str(tmp_path / "pq")).count() == 3


def test_section_sink_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "1A", "y")], "cik STRING, item_n STRING, text STRING")
    tb.write_sections(rows, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"item_n=1", "item_n=1A"}
    only = spark.read.parquet(str(tmp_path / "s")).filter("item_n = '1A'")
    assert [r.text for r in only.collect()] == ["y"]
    assert "PartitionFilters: [isnotnull(item_n" in only._jdf.queryExecution().executedPlan().toString()


def test_coverage(spark):
    similarity = spark.createDataFrame([("1", "2010-02-01", "2009-02-01"), ("1", "2009-02-01", "2007-05-01")], "ticker STRING, a STRING, b STRING").select(
        "ticker", F.to_date("a").alias("date_a"), F.to_date("b").alias("date_b"))
    filings = spark.createDataFrame(
        [("1", f"0000000001-{yy}-00000{i}") for i, yy in enumerate(["10", "09", "08", "07", "06", "06"])] + [("2", "0000000002-99-000001"), ("2", "bad")],
        "cik STRING, accession STRING")
    gaps = sorted((r.cik, r.year) for r in audit.coverage_gaps(filings, similarity).collect())
    assert gaps == [("0000000001", 2006), ("0000000001", 2006), ("0000000001", 2008), ("0000000002", 1999)]


def test_ingest_status_and_counts(spark):
    filers = ix.filer_list(spark.createDataFrame([("1",), ("2 ",), ("3",)], "CIK STRING"))
    landed = spark.createDataFrame([("0000000001",), ("0000000001",), ("0000000002",)], "cik STRING")
    errors = spark.createDataFrame([("0000000002",)], "cik STRING")
    status = audit.ingest_status(filers, landed, errors)
    assert {r.cik[-1]: r.status for r in status.collect()} == {"1": "ok", "2": "error", "3": "not_found"}
    assert {r.status: r.n for r in audit.status_counts(status).collect()} == {"ok": 1, "error": 1, "not_found": 1}
    assert audit.landed_filers(filers, landed).count() == 2
    watched, watch = audit.observed(filers, "filers")
    watched.collect()
    assert watch.get["rows"] == 3


def test_chosen_filers(spark):
    rows = spark.createDataFrame([("0000000001",), ("0000000002",)], "cik STRING")
    assert ix.only_filers(rows).count() == 2
    assert ix.only_filers(rows, ["1 "]).count() == 1
    assert ix.only_filers(rows, spark.createDataFrame([("2",), ("2",)], "cik STRING")).count() == 1


@pytest.mark.parametrize("text,kept", [(" acme", 1), ("Beta", 0)])
def test_name_prefix(spark, text, kept):
    assert ix.name_prefix(spark.createDataFrame([(text,)], "company_name STRING")).count() == kept


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text(",date,ret,cik,company_name\n0,2006-01-31,0.5,12,A\n1,no date,0.5,13,B\n2,2006-03-31,x,14,C\n3,2006-03-31,,15,D\n")
    rows = tb.read_csv(spark, str(tmp_path / "r.csv"), schemas.RETURNS).orderBy("cik").collect()
    assert [(r.cik, r.company_name, str(r.date), r.ret) for r in rows] == [("0000000012", "A", "2006-01-31", 0.5), ("0000000015", "D", "2006-03-31", None)]
    bad = tb.csv_rejects(spark, str(tmp_path / "r.csv"), schemas.RETURNS).orderBy("cik").collect()
    assert [(r.cik, r._bad) for r in bad] == [("0000000013", "date"), ("0000000014", "ret")]


def test_only_submissions_are_read(spark, tmp_path):
    folder = tmp_path / "12" / "10-K" / "0000000012-07-000001"
    folder.mkdir(parents=True)
    for name in ("full-submission.txt", "item1A.txt", "clean-full-submission.txt"):
        (folder / name).write_text(name)
    assert [r.body for r in fl.read_filings(spark, str(tmp_path)).collect()] == ["full-submission.txt"]


def test_every_landed_filing_is_usable_or_rejected(spark):
    rows = [("1", "0000000001-07-000001", "a", "x"), ("1", "0000000001-07-000001", "b", "x"), ("1", "bad", "c", "x"), ("1", "0000000001-05-000001", "d", "x")]
    landed = spark.createDataFrame(rows, "cik STRING, accession STRING, path STRING, body STRING")
    assert [r.path for r in fl.usable_filings(landed).collect()] == ["a"]
    assert sorted(r.reason for r in fl.landing_rejects(landed).collect()) == ["bad_accession", "before_first_year", "duplicate_filing"]


def test_the_header_of_a_long_index_file_is_looked_for_once(spark):
    n = 40_000
    body = "Master index\nCIK|Company Name|Form Type|Date Filed|Filename\n" + "\n".join(f"{i}|x|10-K|2006-01-01|f" for i in range(n))
    files = spark.createDataFrame([("q1", body)], "source_file STRING, body STRING")
    start = time.monotonic()
    got = ix.parse_index(files).agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).first()
    assert tuple(got) == (n, 3, n + 2)
    assert time.monotonic() - start < 15


def test_landed_filings_are_listed_by_tasks(spark, tmp_path):
    """The driver's own listing would hold every file; hidden and empty files are passed over, bytes and names stay as they are."""
    rows = {"1/10-K/a": b"x\ny", "2/10-K/b 2%": b"\xff\xfe", "3/10-K/c": b"", "_h/10-K/d": b"no", "4/_x=1/e": b"yes", "5/6/10-K/g/h": b"deep"}
    for place, body in rows.items():
        folder = tmp_path / "html tree" / place
        folder.mkdir(parents=True)
        (folder / "full-submission.txt").write_bytes(body)
        (folder / "full-other.txt").write_bytes(b"other")
    root = str(tmp_path / "html tree")
    read = fl.read_filings(spark, root)
    assert "FileScan" not in read._jdf.queryExecution().executedPlan().toString().replace("FileScan parquet", "")
    got = {r.accession: (bytes(r.b), r.path) for r in read.select("accession", "path", F.col("body").cast("binary").alias("b")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": b"x\ny", "b%202%25": b"\xff\xfe", "e": b"yes", "h": b"deep"}
    assert got["b%202%25"][1] == f"file:{tmp_path}/html%20tree/2/10-K/b%202%25/full-submission.txt"
    listed = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "full-submission.txt").text(root, wholetext=True)
    assert {v[1] for v in got.values()} == {r.p for r in listed.select(F.col("_metadata.file_path").alias("p")).collect()}
    assert fl.read_filings(spark, [root, f"{root}/1"], "full-{sub,oth}*.tx?").count() == 4 + 5
    assert fl.read_filings(spark, str(tmp_path / "html tree" / "3")).collect() == []
    assert fl.read_filings(spark, f"{root}/[12]").count() == 2
