"""Posting pages and digests written as files and read back."""

import json

from pyspark.sql import functions as F

from lcarank.plans.digest import DIGEST_TITLE, read_digests, write_digests
from lcarank.sources import postings
from lcarank.sources.postings import PAGE_END, PAGE_SPAN, page_number, read_posting_pages, write_posting_pages

RAW = "posting_id string, fetch_ord bigint, title string, company_raw string, location string, created string, url string, description string"


def test_pages_round_trip(spark, tmp_path):
    rows = [(str(i) if i % 4 else "", i, None if i % 5 == 0 else f"t{i} é", "Acme, \"Inc\"" if i % 3 else None, "SF" if i % 7 else None, "2024-01-05T00:00:00Z", f"u{i}", "d\nd" if i % 2 else None)
            for i in range(120)]
    raw = spark.createDataFrame(rows, RAW).repartition(5)
    write_posting_pages(raw, f"{tmp_path}/pages", 50)
    got = read_posting_pages(spark, f"{tmp_path}/pages").orderBy("fetch_ord").collect()
    assert [tuple(r)[2:] for r in got] == [r[2:] for r in rows]
    assert [r.posting_id for r in got] == [r[0] or None for r in rows]
    assert [r.fetch_ord for r in got] == [i // 50 * PAGE_SPAN + i % 50 for i in range(120)]


def test_pages_order_needs_no_window(spark, tmp_path):
    for name, ids in (("page_10.json", "ab"), ("page_9.json", "c"), ("page_011.json", "d")):
        (tmp_path / name).write_text(json.dumps({"results": [{"id": x} for x in ids]}))
    (tmp_path / "page_12.json").write_text("{broken")
    (tmp_path / "page_13.json").write_text('{"results": []}')
    df = read_posting_pages(spark, str(tmp_path))
    assert [r.posting_id for r in df.orderBy("fetch_ord").collect()] == ["c", "a", "b", "d"]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_share_files(spark, tmp_path, monkeypatch):
    """Files grow with the tasks that write, not with the pages, up to a number of pages each."""
    rows = [(str(i), i, f"t{i}\n\x1e\x1e\n \u2028é", "Acme", "SF", None, f"u{i}", "d\x1e\nd" * (i % 9)) for i in range(2000)]
    raw = spark.createDataFrame(rows, RAW).repartition(3)
    expected = [(r[0], r[1] // 5 * PAGE_SPAN + r[1] % 5, *r[2:]) for r in rows]
    for most, few, many in ((postings.PAGES_PER_FILE, 1, 8), (30, 14, 14 + 8)):
        monkeypatch.setattr(postings, "PAGES_PER_FILE", most)
        write_posting_pages(raw, f"{tmp_path}/{most}", 5)
        assert few <= len([p for p in (tmp_path / f"{most}").rglob("part-*")]) <= many and not any(p.is_dir() for p in (tmp_path / f"{most}").iterdir())
        assert [tuple(r) for r in read_posting_pages(spark, f"{tmp_path}/{most}").orderBy("fetch_ord").collect()] == expected


def test_pages_cut_by_splits(spark, tmp_path):
    """A page that a split of a plain file cuts is read once."""
    pages = [{"fetch_page": n, "results": [{"id": f"{n}.{k}", "title": "x" * (97 * k + n)} for k in range(5)]} for n in range(80)]
    (tmp_path / "part-1.json").write_text("".join(json.dumps(p, indent=n % 3 or None) + PAGE_END for n, p in enumerate(pages)))
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in range(771, 777):
            spark.conf.set("spark.sql.files.maxPartitionBytes", f"{most}b")
            got = read_posting_pages(spark, str(tmp_path))
            assert got.rdd.getNumPartitions() > 100
            assert sorted((r.fetch_ord, r.posting_id, len(r.title)) for r in got.collect()) == [
                (n * PAGE_SPAN + k, f"{n}.{k}", 97 * k + n) for n in range(80) for k in range(5)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)


def test_pages_without_number(spark, tmp_path):
    rows = [(str(i), f, None, None, None, None, None, None) for i, f in enumerate([None, -1, -70, 0, 51, 51, None])]
    write_posting_pages(spark.createDataFrame(rows, RAW), f"{tmp_path}/pages", 50)
    got = sorted((r.fetch_ord, r.posting_id) for r in read_posting_pages(spark, f"{tmp_path}/pages").collect())
    assert got == [(0, "0"), (0, "1"), (0, "2"), (0, "3"), (1, "6"), (PAGE_SPAN, "4"), (PAGE_SPAN + 1, "5")]


def test_pages_of_a_provider_in_many_lines(spark, tmp_path):
    for k, code in ((7, "utf-8"), (8, "utf-8-sig"), (9, "utf-16")):
        (tmp_path / f"page_{k}.json").write_text(json.dumps({"count": 2, "results": [{"id": str(k), "title": "Ḋ\nḾ"}, {"id": "b"}]}, indent=2, ensure_ascii=False), code)
    got = read_posting_pages(spark, str(tmp_path)).orderBy("fetch_ord").collect()
    assert [(r.fetch_ord, r.posting_id, r.title) for r in got] == [
        x for k in (7, 8, 9) for x in ((k * PAGE_SPAN, str(k), "Ḋ\nḾ"), (k * PAGE_SPAN + 1, "b", None))]


def test_page_number(spark):
    paths = ["file:/x1/page_007.json", "file:/x/page=12/part-00003-c0ffee.json", "file:/y/none.json", "file:/2024/p3_of.json"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(page_number(F.col("p"))).collect()] == [7, 12, 0, 3]


def test_digests_round_trip(spark, tmp_path):
    rows = []
    for i in [*range(40), 10**12]:
        lines = [DIGEST_TITLE, "", f"_Resume: `resume_{i}` · {i % 3} openings_", "", "> intro", ""] + [f"## {k}. title é # not a start" for k in range(i % 3)] + [""]
        rows += [(i, 7 * k, x) for k, x in enumerate(lines)]
    lines = spark.createDataFrame(rows, "resume_id long, line_no long, line string").repartition(6)
    write_digests(lines, f"{tmp_path}/d", 4)
    folders = sorted(p.name for p in (tmp_path / "d").iterdir() if p.is_dir())
    assert set(folders) <= {f"bucket={k}" for k in range(4)} and len(folders) > 1
    assert all(len(list((tmp_path / "d" / f).glob("part-*.txt"))) == 1 for f in folders)
    got = sorted(map(tuple, read_digests(spark, f"{tmp_path}/d").collect()))
    assert got == sorted((i, n // 7, x) for i, n, x in rows)


def test_line_breaks_in_a_line_and_no_digests(spark, tmp_path):
    rows = [(1, 0, DIGEST_TITLE), (1, 1, ""), (1, 2, "_Resume: `resume_1` · 0_"), (1, 3, "a\r\nb\nc")]
    lines = spark.createDataFrame(rows, "resume_id long, line_no long, line string")
    write_digests(lines, f"{tmp_path}/d", 2)
    assert [r.line for r in read_digests(spark, f"{tmp_path}/d").orderBy("line_no").collect()] == [DIGEST_TITLE, "", "_Resume: `resume_1` · 0_", "a b c"]


def test_digest_lines_are_dealt_out_last(spark, tmp_path):
    """What is worked out of a whole digest stands below the generator: above it, every line would read the digest again."""
    write_digests(spark.createDataFrame([(1, 0, DIGEST_TITLE)], "resume_id long, line_no long, line string"), f"{tmp_path}/d", 1)
    plan = read_digests(spark, f"{tmp_path}/d")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan[:plan.index("Generate posexplode")] and "regexp_extract(" in plan
