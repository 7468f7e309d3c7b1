"""Filing sources: header canonicalisation, column resolution under drift, multi-file scan."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lcarank.functions.names import py_strip
from lcarank.operators.allowlist import build_allowlist, is_certified
from lcarank.plans import queries
from lcarank.sources.filings import _entry, canonical, fiscal_year, header_map, header_rows, read_filings


def test_canonical_header(spark):
    cells = ["EMPLOYER_NAME", " Case Status ", "LCA_CASE_EMPLOYER_NAME", "__x--Y__", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i")
    assert [r[0] for r in df.select(canonical(F.col("c"))).collect()] == ["employer_name", "case_status", "lca_case_employer_name", "x_y", ""]


def test_columns_by_name_then_place(spark):
    files = [("a", ["STATUS", "LCA_CASE_EMPLOYER_NAME"]), ("b", ["employer_city", "employer", "status"]),
             ("c", ["employer_city", "EMPLOYER NAME", "x status", "Case-Status"]), ("d", ["foo", "bar"])]
    got = {r["source_file"]: (r["employer"], r["status"]) for r in header_map(header_rows(spark, files)).collect()}
    assert got == {"a": (1, 0), "b": (0, 2), "c": (1, 3), "d": (None, None)}


def test_csv_rows_keep_file_order_and_may_be_short(spark, tmp_path):
    d = tmp_path / "LCA_FY2022.csv"
    d.mkdir()
    (d / "part-00000-x-c000.csv").write_text("EMPLOYER_NAME,CASE_STATUS\nAcme LLC,Certified\n")
    (d / "part-00001-x-c000.csv").write_text("EMPLOYER_NAME,CASE_STATUS\n" + "ACME INC,Certified\n" * 50 + "Short\n")
    (tmp_path / "LCA_FY2023.csv").write_text("Employer,Status,More\nGlobex,Certified\n\"A, B\",Denied,x\n")
    (tmp_path / "empty_FY2024.csv").write_text("")
    rows = read_filings(spark, str(tmp_path), "csv")
    assert rows.count() == 54 and rows.where("case_status is null").count() == 1
    first = build_allowlist(rows).where("norm_name = 'acme'").first()
    assert first["raw_name"] == "Acme LLC" and first["filings"] == 51


def test_files_without_the_columns_are_refused(spark, tmp_path):
    pd.DataFrame({"foo": [1]}).to_parquet(tmp_path / "LCA_FY2020.parquet")
    with pytest.raises(ValueError, match="foo"):
        read_filings(spark, str(tmp_path))


@pytest.mark.parametrize("name,year", [
    ("LCA_Disclosure_Data_FY2019.parquet", 2019), ("H1B_2021_Q4.csv", 2021),
    ("LCA_FY1999.parquet", 0), ("dir/FY2023_x.parquet", 2023), ("nothing.parquet", 0),
])
def test_fiscal_year(spark, name, year):
    df = spark.createDataFrame([(name,)], "f string")
    assert df.select(fiscal_year(F.col("f"))).first()[0] == year


def test_read_filings_with_header_drift(spark):
    d = tempfile.mkdtemp(prefix="lcarank-filings-")
    pd.DataFrame({"CASE_STATUS": ["Certified", "Denied", "Certified"],
                  "EMPLOYER_NAME": ["Acme LLC", "Acme LLC", "Initech Inc"]}).to_parquet(
        os.path.join(d, "LCA_Disclosure_Data_FY2019.parquet"))
    pd.DataFrame({"LCA_CASE_EMPLOYER_NAME": ["ACME, INC.", "Globex"],
                  "EMPLOYER_CITY": ["X", "Y"], "STATUS": ["CERTIFIED", "certified-withdrawn"]}).to_parquet(
        os.path.join(d, "LCA_FY2020.parquet"))
    pd.DataFrame({"A": ["x"]}).to_parquet(os.path.join(d, "~$LCA_FY2021.parquet"))   # editor lock file
    f = read_filings(spark, d)
    rows = sorted((r.source_file, r.row_ord, r.employer_name, r.case_status) for r in f.collect())
    assert rows == [
        ("LCA_Disclosure_Data_FY2019.parquet", 0, "Acme LLC", "Certified"),
        ("LCA_Disclosure_Data_FY2019.parquet", 1, "Acme LLC", "Denied"),
        ("LCA_Disclosure_Data_FY2019.parquet", 2, "Initech Inc", "Certified"),
        ("LCA_FY2020.parquet", 0, "ACME, INC.", "CERTIFIED"),
        ("LCA_FY2020.parquet", 1, "Globex", "certified-withdrawn"),
    ]
    got = {r.norm_name: (r.filings, r.latest_year, r.raw_name) for r in build_allowlist(f).collect()}
    assert got == {"acme": (2, 2020, "Acme LLC"), "initech": (1, 2019, "Initech Inc"),
                   "globex": (1, 2020, "Globex")}


def test_read_filings_csv_ragged(spark):
    d = tempfile.mkdtemp(prefix="lcarank-filings-csv-")
    with open(os.path.join(d, "FY2022.csv"), "w") as fh:
        fh.write("Employer Name,Case Status\nAcme LLC,Certified\nShort Row\n,Certified\nInitech,Certified\n")
    f = read_filings(spark, d, fmt="csv")
    assert f.count() == 4
    got = {r.norm_name: r.filings for r in build_allowlist(f).collect()}
    assert got == {"acme": 1, "initech": 1}


def test_read_filings_empty_dir(spark):
    with pytest.raises(FileNotFoundError):
        read_filings(spark, tempfile.mkdtemp(prefix="lcarank-empty-"))


def test_short_rows_are_told_from_empty_cells(spark, tmp_path):
    """A row that ends before the employer or the status is short; a row with an empty cell is not."""
    from lcarank.operators.allowlist import filing_accounts

    (tmp_path / "a_FY2022.csv").write_text('EMPLOYER_NAME,CASE_STATUS,NOTE\nAcme,Certified,x\n"A, ""B"" C"\n"A, B",Certified,x\nAcme,Certified\n,Certified,x\nAcme,,x\nAcme,Denied,x,more,cells\n')
    (tmp_path / "b_FY2023.csv").write_text("STATUS,CITY,EMPLOYER\nCertified\nCertified,x\nCertified,x,Acme\nCertified,x,\n")
    rows = read_filings(spark, str(tmp_path), "csv", short_rows=True)
    assert rows.count() == 11 and build_allowlist(rows.drop("short")).where("norm_name = 'acme'").first()["filings"] == 3
    got = {r.source_file: (r.rows, r.short_rows, r.rows_certified, r.rows_named) for r in filing_accounts(rows).collect()}
    assert got == {"a_FY2022.csv": (7, 1, 4, 3), "b_FY2023.csv": (4, 2, 2, 1)}
    plain = sorted(map(tuple, read_filings(spark, str(tmp_path), "csv").select("source_file", "employer_name", "case_status").collect()), key=str)
    assert plain == sorted(map(tuple, rows.select("source_file", "employer_name", "case_status").collect()), key=str)


def test_parquet_rows_are_never_short(spark, tmp_path):
    pd.DataFrame({"CASE_STATUS": ["Certified", None], "EMPLOYER_NAME": [None, "Acme"]}).to_parquet(tmp_path / "x_FY2020.parquet")
    assert [r.short for r in read_filings(spark, str(tmp_path), short_rows=True).collect()] == [False, False]


@pytest.mark.parametrize("query", ["filings_csv", "filings_csv_accounts", "filings_files"])
def test_filings_are_derived_once(spark, monkeypatch, query):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    rows = [(f"LCA_FY{2018 + i % 4}.parquet", i, "Acme, Inc" if i % 3 else None, "Certified" if i % 5 else "Denied") for i in range(60)]
    table = spark.createDataFrame(rows, "source_file string, row_ord long, employer_name string, case_status string")
    monkeypatch.setattr(queries.views, "lca_filings", lambda s, d: table.withColumn("source_file", counted("source_file")))
    got = getattr(queries, query)(spark, "").collect()
    assert seen.value == 60
    if query == "filings_csv_accounts":
        assert {r.source_file for r in got} == {f"LCA_FY{2018 + k}.csv" for k in range(4)} and sum(r.rows for r in got) == 60
    else:
        whole = [r for r in rows if r[2] and r[3] == "Certified" and (query == "filings_files" or r[1] % 7)]
        assert [tuple(r) for r in got] == [("acme", len(whole), 2021)]


def test_entry_of_a_path(spark):
    paths = ["file:/a/b/x%20y.csv/part-0.txt", "file:/a/b.csv", "file:/a/d.csv/p.csv", "file:/a/.csv/q", "file:/a.csv/b/c.txt", "file:/a/1%2B.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    old = F.url_decode(F.regexp_extract("p", r"([^/]+\.csv)(?:/[^/]*)?$", 1))
    got = df.select(_entry(F.col("p"), "csv"), old).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == ["x y.csv", "b.csv", "d.csv", "", "", "1+.csv"]
    assert "regexp" not in df.select(_entry(F.col("p"), "csv"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_certified(spark):
    texts = ["certified", " CERTIFIED - WITHDRAWN ", "\x1f　\nCertiFied", "x certified", "", " ", "cert", "Certıfied", "CERTİFIED", "denied\ncertified", "​certified", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.coalesce(F.startswith(F.lower(py_strip("t")), F.lit("certified")), F.lit(False))
    got = df.select(is_certified(F.col("t")), old).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [True] * 3 + [False] * 9


def test_names_are_normalised_after_the_aggregate(spark):
    """A filter on the key alone would move below the aggregate: every row's name, not every distinct name, normalised."""
    rows = [("FY2020.parquet", i, n, "Certified") for i, n in enumerate(["Acme, Inc", "Acme Inc", "!!", "", None])]
    allow = build_allowlist(spark.createDataFrame(rows, "source_file string, row_ord long, employer_name string, case_status string"))
    plan = allow._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "regexp_replace(" in plan and "regexp_replace(" not in plan.split("Aggregate [")[-1]
    assert [(r.norm_name, r.raw_name, r.filings) for r in allow.collect()] == [("acme", "Acme, Inc", 2)]
