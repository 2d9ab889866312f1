"""Filings, patents, papers and tables from small hand-written texts."""

import io
import zipfile

from pyspark.sql import functions as F

from plover.sources import markup, readers

FILING = """<xbrl xmlns:p="urn:p"><p:NetSales contextRef="Prior1YearDuration">10</p:NetSales><p:NetSales contextRef="CurrentYearDuration">1,234</p:NetSales><p:NetSales contextRef="CurrentYearDuration">9</p:NetSales>
<p:Average contextRef="CurrentYearInstant">7</p:Average><p:Average contextRef="CurrentYearInstant_NonConsolidatedMember">8</p:Average><p:NetSales>no context</p:NetSales></xbrl>"""


def test_filings_in_zip_files(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as files:
        files.writestr("XBRL/PublicDoc/a.xbrl", FILING)
        files.writestr("XBRL/PublicDoc/b.xml", "<broken")
        files.writestr("notes.xml", FILING.replace("1,234", "1"))
    rows = [(1, held.getvalue()), (2, FILING.encode()), (3, b"PK no zip"), (4, None), (5, b""), (6, b"<x")]
    found = markup.resolved_facts(spark.createDataFrame(rows, "k int, content binary"), "k", "content", {"sales": ["NetSales"], "mean": ["Average"]}, own=("mean",))
    assert {(r["k"], r["field"]): r["value"] for r in found.collect()} == {(k, f): v for k in (1, 2) for f, v in (("sales", "1,234"), ("mean", "8"))}


def test_context_priorities(spark):
    names = ["CurrentYearDuration", "CurrentYearInstant", "CurrentYearDuration_NonConsolidatedMember", "CurrentYearDuration_ReportableSegmentsMember", "FilingDateInstant", None]
    rows = spark.createDataFrame([(n,) for n in names], "c string").select("c", markup.context_priority(F.col("c")).alias("g"), markup.context_priority(F.col("c"), True).alias("o")).collect()
    assert [(r["g"], r["o"]) for r in rows] == [(100, 80), (80, 60), (58, 96), (58, 80), (10, -10), (20, 0)]


def test_employee_tables(spark):
    table = "<table><tr><td>従業員数（人）</td><td>平均年齢</td><td>平均勤続年数（年）</td><td>平均年間給与（円）</td></tr><tr><td>1,234</td><td>〔56〕</td><td>40.1</td><td>{}</td><td>6,543,210</td></tr></table>"
    rows = [(1, table.format("12.5")), (2, table.format("80")), (3, "<p>no table</p>"), (4, None), (5, "<td>従業員数</td>")]
    got = {r["k"]: tuple(r["x"]) for r in spark.createDataFrame(rows, "k int, h string").select("k", markup.employee_table(F.col("h")).alias("x")).collect()}
    assert got[1] == (1234.0, 12.5, 6543210.0) and got[2] == (1234.0, None, 6543210.0) and got[3] == got[4] == got[5] == (None, None, None)


def test_patents_and_families(spark):
    xml = """<w xmlns="urn:x"><exchange-document country="EP" doc-number="1" kind="A1" family-id="77"><bibliographic-data><publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>1</doc-number><kind>A1</kind><date>20240102</date></document-id></publication-reference>
    <invention-title lang="de">Titel</invention-title><invention-title lang="en">A  title</invention-title><references-cited><citation><patcit dnum="US 5-A"/></citation></references-cited></bibliographic-data><abstract lang="en"><p>One.</p></abstract></exchange-document><exchange-document country="JP" doc-number="2" kind="B"/></w>"""
    family = """<f xmlns="urn:x"><family-member><publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>1</doc-number><kind>A1</kind></document-id></publication-reference></family-member><family-member><publication-reference><document-id document-id-type="docdb"><country>JP</country><doc-number>2</doc-number></document-id></publication-reference><legal code="PG" desc="patent {}"/></family-member></f>"""
    df = spark.createDataFrame([(1, xml, family.format("granted")), (2, "<x", family.format("lapsed")), (3, None, None), (4, "", "<f/>")], "k int, x string, f string")
    got = {r["k"]: r for r in df.select("k", markup.patent_records(F.col("x")).alias("p"), markup.patent_family(F.col("f")).alias("f")).collect()}
    one, two = got[1]["p"]
    assert (one["number"], one["family"], one["title"], one["abstract"], one["citations"], one["published"], one["claims"]) == ("EP1A1", "77", "A title", "One.", ["US5A"], "20240102", 0)
    assert two["number"] == "JP2B" and got[2]["p"] == got[3]["p"] == got[4]["p"] == []
    assert (got[1]["f"]["members"], got[1]["f"]["countries"], got[1]["f"]["status"]) == (["EP1A1", "JP2"], ["EP", "JP"], "granted")
    assert got[2]["f"]["status"] == "inactive" and got[4]["f"]["status"] == ""


def test_papers_that_cannot_be_read(spark):
    df = spark.createDataFrame([("<feed",), (None,), ("<feed><entry/></feed>",)], "x string")
    assert [len(r["a"]) for r in df.select(markup.arxiv_entries(F.col("x")).alias("a")).collect()] == [0, 0, 1]
    assert [len(r["a"]) for r in df.select(markup.jstage_entries(F.col("x")).alias("a")).collect()] == [0, 0, 0]
    lines = spark.createDataFrame([("{",), (None,), ('{"id": "https://o/W1"}',)], "line string")
    assert [tuple(r) for r in markup.openalex_papers(lines, "line").select("source_id", "title", "abstract", "authors", "pdf_url").collect()] == [("W1", "", "", [], "")]


def test_disclosures_fall_back_and_repeat_once(spark):
    html = "<tr><td>2024/1/5</td>7203 業績予想の修正<a href='x.pdf'></a></tr><tr><td>7203 配当 の件</td></tr><tr>2024-01-05 7203 業績予想の修正</tr><tr>9999 業績予想</tr>\n7203 other"
    df = spark.createDataFrame([("7203", html)], "code string, html string").withColumn("day", F.lit("2020-02-02").cast("date"))
    got = sorted((str(r["day"]), r["title"], r["url"]) for r in markup.disclosures(df, "html", "code", "day", ("業績予想", "配当"), "https://h", "https://h/f").collect())
    assert got == [("2020-02-02", "配当 の件", ""), ("2024-01-05", "業績予想の修正", "")]


def test_rules_of_columns_and_thresholds(spark):
    df = spark.createDataFrame([], "a_key long, day date, price double, n int, s string")
    assert readers.feature_rules(df, {"price": 3}) == [("a_key", "identifier", 0), ("day", "date", 0), ("price", "feature", 3), ("n", "feature", 1), ("s", "text", 0)]
    assert readers.threshold_sets("a:1:2; b:3:4;") == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    for bad in ("a:2:1", ":1:2", "a:1:2;a:1:3"):
        try:
            readers.threshold_sets(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
