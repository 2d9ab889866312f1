"""Source and sink queries, by round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from plover.plans.registry import query
from plover.session import scratch_path
from plover.sources import markup, readers
from plover.sources.tables import PRICES_SQL, prices


@query("s01_s03_scan_ordered_prices", f"WITH {PRICES_SQL} SELECT symbol, day, close FROM px WHERE symbol = 7 AND close > 0")
def s01(t):
    return prices(t.lineitem.filter("l_suppkey = 7")).filter("close > 0").select("symbol", "day", "close")


@query("s05_s06_s29_s32_s33_csv_round_trip", "SELECT n_nationkey::VARCHAR AS number, n_name AS company, '' AS note FROM nation")
def s05(t):
    path = scratch_path(t.spark, "csv")
    readers.write_localised(t.nation, path, {"n_nationkey": "法人番号", "n_name": "企業名"})
    return readers.with_aliases(readers.read_csv(t.spark, path), {"number": ["法人番号"], "company": ["会社名", "企業名"], "note": ["備考"]})


@query("s05_s06_encoding_fallback", "SELECT n_nationkey::VARCHAR AS number, '株式会社ソ表 ' || n_name || ', \"引用\"' AS company, origin FROM nation, (VALUES ('utf-8'), ('cp932'), ('plain')) v(origin)")
def s05_encodings(t):
    """The same master written in UTF-8, in code page 932, and in the latter under plain ASCII headers; each is read by what its rows are."""
    rows = t.nation.select(F.col("n_nationkey").cast("string").alias("法人番号"), F.concat(F.lit("株式会社ソ表 "), "n_name", F.lit(', "引用"')).alias("企業名"))
    out, order = None, ("UTF-8", "cp932", "shift_jis")
    for origin, df in (("utf-8", rows), ("cp932", rows), ("plain", rows.toDF("number", "company"))):
        path = scratch_path(t.spark, "encoded")
        if origin == "utf-8":
            df.write.option("header", True).option("escape", '"').csv(path)
        else:
            readers.write_csv_encoded(df, path, "cp932")
        found = readers.with_aliases(readers.read_csv(t.spark, path, order), {"number": ["法人番号"], "company": ["会社名", "企業名"]}).withColumn("origin", F.lit(origin))
        out = found if out is None else out.unionByName(found)
    return out


@query("s07_s08_s09_p01_job_files", "SELECT lpad(s_suppkey::VARCHAR, 13, '1') AS number, s_name AS company, n_name AS place, 'csv' AS origin FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 <> 0 UNION ALL SELECT lpad(s_suppkey::VARCHAR, 13, '1'), s_name, '', 'jsonl' FROM supplier WHERE s_suppkey % 4 <> 0")
def s08(t):
    """Job files of two kinds with headers of their own become canonical columns; the master keeps 13 digits only."""
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.lit("12-3")).otherwise(F.lpad(F.col("s_suppkey").cast("string"), 13, "1"))
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(raw.alias("法人番号"), F.col("s_name").alias("会社名"), F.col("n_name").alias("勤務地"))
    csv, lines = scratch_path(t.spark, "jobs") + ".csv", scratch_path(t.spark, "jobs") + ".jsonl"
    rows.write.option("header", True).csv(csv)
    rows.select(F.col("法人番号").alias("Corporate Number"), F.col("会社名").alias("company-name")).write.json(lines)
    aliases = {"number": ["法人番号", "corporate_number"], "company": ["会社名", "company_name"], "place": ["勤務地", "work_location"]}
    out = [readers.with_aliases(readers.read_table(t.spark, path), aliases).withColumn("origin", F.lit(kind)) for path, kind in ((csv, "csv"), (lines, "jsonl"))]
    return out[0].unionByName(out[1]).filter(F.col("number").rlike(r"^\d{13}$"))


@query("s10_reload_clean", "SELECT c_custkey::VARCHAR AS id, c_name AS name, '' AS note FROM customer WHERE c_acctbal > 0")
def s10(t):
    """A clean table of an earlier run, whose columns have changed since."""
    path = scratch_path(t.spark, "clean") + ".parquet"
    kept = F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string"))
    t.customer.select(kept.alias("id"), F.col("c_name").alias("name"), "c_acctbal").write.parquet(path)
    return readers.reload_clean(t.spark, path, ["id", "name", "note"], "id")


@query("s13_s23_json_lines", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3")
def s13(t):
    """JSON lines compressed with gzip; every tenth line is broken and left out."""
    path = scratch_path(t.spark, "jsonl")
    line = F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    t.events.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_json_lines(t.spark, path, "event_id long, event_type string")


@query("s11_s12_multi_values", "SELECT p_partkey, len(string_split(p_type, ' ')) + 1 AS n, array_to_string(list_concat(string_split(p_type, ' '), [p_brand]), '|') AS parts FROM part")
def s11(t):
    """A CSV of records with several values in a cell, parted by bars, semicolons or line breaks."""
    path = scratch_path(t.spark, "patents") + ".csv"
    cell = F.concat(F.regexp_replace("p_type", " ", " | "), F.lit(";; \n"), "p_brand", F.lit(";"))
    t.part.select(F.col("p_partkey").alias("Publication Number"), cell.alias("出願人")).write.option("header", True).option("quoteAll", True).csv(path)
    found = t.spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = readers.with_aliases(found, {"publication_number": [], "applicants": ["出願人"]}).withColumn("p", readers.split_values("applicants"))
    return rows.select(F.col("publication_number").cast("long").alias("p_partkey"), F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("parts"))


@query("s14_s15_s16_semi_join_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def s14(t):
    keys = t.customer.filter("c_acctbal > 9500").select(F.col("c_custkey").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    keys = keys.unionByName(t.lineitem.filter("l_quantity = 50").select(F.lit(None).cast("string").alias("a"), F.col("l_orderkey").cast("string").alias("b")))
    path = scratch_path(t.spark, "orders") + ".csv"
    t.orders.write.option("header", True).csv(path)
    return readers.semi_join_csv(t.spark, path, keys, [("o_custkey", "a"), ("o_orderkey", "b")], ["o_orderkey", "o_orderpriority"])


@query("s14_semi_join_pushdown", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def s16(t):
    keys = t.customer.filter("c_acctbal > 9500").select(F.col("c_custkey").alias("a"), F.lit(None).cast("long").alias("b"))
    keys = keys.unionByName(t.lineitem.filter("l_quantity = 50").select(F.lit(None).cast("long").alias("a"), F.col("l_orderkey").alias("b")))
    return readers.semi_join_any(t.orders.select("o_orderkey", "o_custkey"), keys, [("o_custkey", "a"), ("o_orderkey", "b")]).select("o_orderkey")


@query("s18_html_employee_tables", "SELECT s_suppkey, (s_suppkey*7 + 10)::DOUBLE AS employees, CASE WHEN s_nationkey + 40.5 <= 60 THEN s_nationkey + 40.5 END::DOUBLE AS service_years, CASE WHEN (s_suppkey*100 + 50)*1000 >= 100000 THEN ((s_suppkey*100 + 50)*1000)::DOUBLE END AS salary FROM supplier")
def s18(t):
    number = lambda c: F.format_number(c, 0)
    html = F.concat(
        F.lit("<table><tr><th>年齢</th><th>従業員数<br>（人）</th><td>平均年齢（歳）</td><th>平均勤続年数（年）</th><th>平均年間給与（千円）</th></tr><tr><td></td><td class='n'><b>"), number(F.col("s_suppkey") * 7 + 10), F.lit("</b></td><td>(3)</td><td>41.2</td><td>"),
        (F.col("s_nationkey") + 40.5).cast("string"), F.lit("</td><td>"), number(F.col("s_suppkey") * 100 + 50), F.lit("</td></tr></table>"),
    )
    return t.supplier.select("s_suppkey", markup.employee_table(html).alias("x")).select("s_suppkey", "x.*")


@query("s28_disclosures", "SELECT o_custkey::VARCHAR AS code, o_orderdate::DATE AS day, '業績予想の修正 ' || o_orderpriority AS title, min('https://host/inbs/' || o_orderkey || '.pdf') AS url FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3 UNION ALL SELECT o_custkey::VARCHAR, o_orderdate::DATE, '自己株式の取得', min('https://host/' || o_orderkey || '.pdf') FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2, 3")
def s28(t):
    """A page of table rows per customer; rows of other codes or without a keyword are no disclosures."""
    day, key = F.date_format("o_orderdate", "yyyy/M/d"), F.col("o_orderkey").cast("string")
    row = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<tr><td>"), day, F.lit("</td><td>"), F.col("o_custkey").cast("string"), F.lit("</td><td><a href='./"), key, F.lit(".pdf'>業績予想の修正 "), "o_orderpriority", F.lit("</a></td></tr>")))
    row = row.when(F.col("o_orderstatus") == "P", F.concat(F.lit("<tr><td>"), day, F.lit("</td><td>"), F.col("o_custkey").cast("string"), F.lit('</td><td><a href="/'), key, F.lit('.pdf">自己株式の取得</a></td></tr>')))
    row = row.otherwise(F.concat(F.lit("<tr><td>"), F.col("o_custkey").cast("string"), F.lit("</td><td>お知らせ</td></tr>")))
    pages = t.orders.select(F.col("o_custkey").cast("string").alias("code"), row.alias("html"), F.lit("1990-01-01").cast("date").alias("fallback"))
    return markup.disclosures(pages, "html", "code", "fallback", ("業績予想", "自己株式", "配当予想"), "https://host", "https://host/inbs")


@query("s24_quadgram_files", """WITH w AS (SELECT conv_id*1000 + turn AS doc_id, conv_id % 3 AS stamp, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM conversations)
SELECT stamp, doc_id, len(ws) - 3 AS n_grams, array_to_string(list_sort(list_filter(['and', 'of', 'the'], lambda t: list_contains(ws, t))), ',') AS hits FROM w WHERE len(ws) >= 4""")
def s24(t):
    """Gzip TSV files of quadgrams per stamp and document, grouped again and matched with terms."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), (F.col("conv_id") % 3).alias("stamp"), words.alias("w")).filter("size(w) >= 4")
    grams = rows.select("stamp", "doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda k: F.array_join(F.slice("w", k, 4), " "))).alias("gram"))
    path = scratch_path(t.spark, "quadgrams")
    grams.select("stamp", "doc_id", "gram", F.lit(1).alias("n")).write.partitionBy("stamp").option("sep", "\t").option("compression", "gzip").csv(path)
    found = t.spark.read.schema("doc_id long, gram string, n int, stamp long").option("sep", "\t").csv(path)
    return markup.quadgram_documents(found, ("the", "and", "of")).withColumn("hits", F.array_join("hits", ","))


@query("s27_e04_e05_wide_to_long", "SELECT c_custkey, measure, value FROM (SELECT c_custkey, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer) UNPIVOT (value FOR measure IN (balance, nation))")
def s27(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation")).unpivot("c_custkey", ["balance", "nation"], "measure", "value")


@query("s35_import_with_status", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'invalid_number' WHEN p_size < 5 THEN 'too_small' ELSE 'ok' END AS status FROM part")
def s35(t):
    raw = F.when(F.col("p_partkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    value = raw.try_cast("double")
    return t.part.select("p_partkey", F.when(value.isNull(), "invalid_number").when(value < 5, "too_small").otherwise("ok").alias("status"))


@query("p48_feature_rules", "SELECT * FROM (VALUES ('l_orderkey', 'identifier', 0), ('l_partkey', 'identifier', 0), ('l_suppkey', 'identifier', 0), ('l_linenumber', 'feature', 1), ('l_quantity', 'feature', 1), ('l_extendedprice', 'feature', 2), ('l_discount', 'feature', 1), ('l_tax', 'feature', 1), ('l_returnflag', 'text', 0), ('l_linestatus', 'text', 0), ('l_shipdate', 'date', 0)) v(name, eligibility, priority)")
def p48(t):
    """Which columns of a table may be model features, and how much they are preferred, by name and type."""
    rules = readers.feature_rules(t.lineitem, priority={"price": 2})
    return t.spark.createDataFrame(rules, "name string, eligibility string, priority int")


@query("p54_threshold_sets", "SELECT s.name, count(*) FILTER (o_totalprice < s.small) AS small, count(*) FILTER (o_totalprice >= s.small AND o_totalprice < s.large) AS mid, count(*) FILTER (o_totalprice >= s.large) AS large FROM orders CROSS JOIN (VALUES ('base', 100000.0, 200000.0), ('wide', 50000.0, 300000.0)) s(name, small, large) GROUP BY 1")
def p54(t):
    """Orders by size under sets of boundaries that a text gives."""
    counts = []
    for name, small, large in readers.threshold_sets("base:100000:200000; wide:50000:300000;"):
        v = F.col("o_totalprice")
        counts.append(F.struct(F.lit(name).alias("name"), F.count_if(v < small).alias("small"), F.count_if((v >= small) & (v < large)).alias("mid"), F.count_if(v >= large).alias("large")))
    return t.orders.agg(F.array(*counts).alias("c")).select(F.inline("c"))


@query("e08_e48_canonical_records", "SELECT sha256(s_suppkey || '|' || s_name) AS record_hash, s_suppkey::VARCHAR AS source_record_id, s_name AS company_name, '' AS address, s_acctbal::VARCHAR AS score_balance FROM supplier")
def e48(t):
    """A collected record in the canonical columns, with its row id and hash, then the columns that a view asks for."""
    aliases = {"source_record_id": ["s_suppkey"], "company_name": ["s_name"], "address": ["住所"], "score_balance": ["s_acctbal"]}
    rows = readers.with_aliases(t.supplier, aliases)
    return rows.select(F.sha2(F.concat_ws("|", "source_record_id", "company_name"), 256).alias("record_hash"), *[c for c in aliases if c in rows.columns])


def _xml(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("s19_patent_documents", "SELECT 'EP' || s_suppkey || 'A1' AS number, s_nationkey::VARCHAR AS family, 'Title ' || s_suppkey AS title, s_name AS applicant, 'A01B1/' || s_nationkey AS ipc, 'H04L9/' || (s_suppkey % 50) AS cpc, 'US' || s_suppkey || 'B2' AS cited, (1 + s_suppkey % 3)::INT AS claims, '20200101' AS published, '2019' || lpad((1 + s_suppkey % 12)::VARCHAR, 2, '0') || '01' AS priority FROM supplier")
def s19(t):
    """Exchange documents in files of one nation's suppliers each."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    claims = F.array_join(F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: F.concat(F.lit("<claim>c"), i.cast("string"), F.lit("</claim>"))), "")
    one = _xml(
        '<e:exchange-document country="EP" doc-number="', k, '" kind="A1" family-id="', n, '"><b><publication-reference><document-id document-id-type="epodoc"><doc-number>EP', k, '</doc-number></document-id><document-id document-id-type="docdb"><country>EP</country><doc-number>', k,
        '</doc-number><kind>A1</kind><date>20200101</date></document-id></publication-reference><priority-claims><priority-claim><document-id><doc-number>X', k, "</doc-number><date>2019", F.lpad((1 + k % 12).cast("string"), 2, "0"),
        '01</date></document-id></priority-claim></priority-claims><parties><applicants><applicant><applicant-name><name>', F.col("s_name"), "</name></applicant-name></applicant><applicant><applicant-name><name>", F.col("s_name"), '</name></applicant-name></applicant></applicants></parties><classifications-ipcr><classification-ipcr><text>A01B 1/ ',
        n, "</text></classification-ipcr></classifications-ipcr><patent-classifications><patent-classification><classification-scheme office='EP' scheme='CPCI'/><section>H</section><class>04</class><subclass>L</subclass><main-group>9</main-group><subgroup>", k % 50,
        "</subgroup></patent-classification></patent-classifications><references-cited><citation><patcit><document-id document-id-type='docdb'><country>US</country><doc-number>", k, "</doc-number><kind>B2</kind></document-id></patcit></citation></references-cited><invention-title lang='fr'>Titre</invention-title><invention-title lang='en'>Title  ",
        k, "</invention-title></b><claims>", claims, "</claims></e:exchange-document>",
    )
    files = t.supplier.select(_xml('<w xmlns="urn:x" xmlns:e="urn:e">', one, "</w>").alias("xml"))
    found = files.select(F.explode(markup.patent_records(F.col("xml"))).alias("p")).select("p.*")
    return found.select("number", "family", "title", F.array_join("applicants", "|").alias("applicant"), F.array_join("ipc", "|").alias("ipc"), F.array_join("cpc", "|").alias("cpc"), F.array_join("citations", "|").alias("cited"), "claims", "published", "priority")


@query("s20_openalex_papers", "SELECT 'W' || p_partkey AS source_id, trim(p_name) AS title, regexp_replace(trim(p_type), ' +', ' ', 'g') AS abstract, p_brand AS authors, '10.1/' || p_partkey AS doi, CASE WHEN p_partkey % 2 = 0 THEN 'http://x/' || p_partkey || '.pdf' ELSE '' END AS pdf_url, 'T' || p_size AS categories FROM part WHERE p_partkey % 9 <> 0")
def s20(t):
    """Works as JSON lines, every ninth of them broken."""
    words = F.split(F.regexp_replace(F.trim("p_type"), " +", " "), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.element_at(words, i + 1) == w))))
    key, none = F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    pdf = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://x/"), key, F.lit(".pdf")))
    named = lambda c: F.struct(c.alias("display_name"))
    topic = F.struct(F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("display_name"), named(none).alias("subfield"), named(none).alias("field"))
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), key).alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.concat(F.lit("10.1/"), key).alias("doi"), index.alias("abstract_inverted_index"),
        F.array(F.struct(named(F.col("p_brand")).alias("author")), F.struct(named(F.lit(" ")).alias("author"))).alias("authorships"), F.array(F.struct(none.alias("pdf_url")), F.struct(pdf.alias("pdf_url"))).alias("locations"), F.array(topic).alias("topics"),
    )
    lines = t.part.select(F.when(F.col("p_partkey") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(work)).alias("line"))
    return markup.openalex_papers(lines, "line").select("source_id", "title", "abstract", F.array_join("authors", "|").alias("authors"), "doi", "pdf_url", F.array_join("categories", "|").alias("categories"))


@query("s21_paper_feeds", "SELECT '2401.' || s_suppkey AS source_id, s_name AS title, 'a of ' || s_suppkey AS authors, 'cs.' || s_nationkey AS categories, 'http://arxiv.org/pdf/2401.' || s_suppkey || 'v3' AS pdf_url, '' AS journal FROM supplier UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN '10.2/' || c_custkey ELSE 'http://j/' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN '題名' ELSE c_name END, 'b', '', '', c_mktsegment FROM customer WHERE c_custkey % 7 <> 0")
def s21(t):
    """Atom feeds of both kinds; a feed that reports an error has no entries."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    entry = _xml("<entry><id>http://arxiv.org/abs/2401.", k, "v3</id><title> ", F.col("s_name"), "\n </title><summary>s</summary><author><name>a  of ", k, "</name></author><link type='text/html' href='h'/><link type='application/pdf' href='http://arxiv.org/pdf/2401.", k, "v3'/><category term='cs.", F.col("s_nationkey"), "'/></entry>")
    one = t.supplier.select(markup.arxiv_entries(_xml("<feed xmlns='http://www.w3.org/2005/Atom'>", entry, "</feed>")).alias("e"))
    japanese = F.when(c % 3 == 0, F.lit("<ja>題名</ja>")).otherwise(F.lit("<ja> </ja>"))
    doi = F.when(c % 2 == 0, _xml("<doi>10.2/", c, "</doi>")).otherwise(F.lit(""))
    item = _xml("<entry><article_title>", japanese, "<en>", F.col("c_name"), "</en></article_title><article_link><ja>http://j/", c, "</ja></article_link><material_title><en>", F.col("c_mktsegment"), "</en></material_title>", doi, "<author><en><name>b</name></en></author><author><en><name>b</name></en></author></entry>")
    two = t.customer.select(markup.jstage_entries(_xml("<feed><result><status>", F.when(c % 7 == 0, F.lit("ERR_001")).otherwise(F.lit("0")), "</status></result>", item, "</feed>")).alias("e"))
    rows = one.unionByName(two).select(F.explode("e").alias("p")).select("p.*")
    return rows.select("source_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"), "pdf_url", "journal")


@query("s17_e07_xbrl_filings", "SELECT s_suppkey, field, value, CASE WHEN s_suppkey % 4 = 0 THEN 'partial' ELSE 'parsed' END AS status FROM (SELECT s_suppkey, 'sales' AS field, (s_suppkey*1000)::VARCHAR AS value FROM supplier UNION ALL SELECT s_suppkey, 'employees', (s_nationkey + 1)::VARCHAR FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, 'property', 'text of ' || s_suppkey FROM supplier)")
def s17(t):
    """Filings as instance documents; the current year's consolidated sales and the company's own employees count."""
    k = F.col("s_suppkey")
    own = F.when(k % 4 != 0, _xml("<jp:NumberOfEmployees contextRef='CurrentYearInstant'>999</jp:NumberOfEmployees><jp:NumberOfEmployees contextRef='CurrentYearInstant_NonConsolidatedMember'>", F.col("s_nationkey") + 1, "</jp:NumberOfEmployees>")).otherwise(F.lit(""))
    xml = _xml(
        "<xbrl xmlns:jp='urn:jp'><jp:NetSales contextRef='Prior1YearDuration'>1</jp:NetSales><jp:NetSales contextRef='CurrentYearDuration_ReportableSegmentMember'>2</jp:NetSales><jp:NetSales contextRef='CurrentYearDuration'>", k * 1000,
        "</jp:NetSales><jp:NetSales contextRef='CurrentYearDuration_NonConsolidatedMember'>3</jp:NetSales>", own, "<jp:Property contextRef='FilingDateInstant'>text  of\n", k, "</jp:Property><jp:Other contextRef='x'>4</jp:Other></xbrl>",
    )
    fields = {"sales": ["NetSales", "Revenue"], "employees": ["NumberOfEmployees"], "property": ["Property"]}
    found = markup.resolved_facts(t.supplier.select("s_suppkey", xml.alias("xml")), "s_suppkey", "xml", fields, own=("employees",))
    counts = found.groupBy(F.col("s_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(counts, F.col("s_suppkey") == F.col("k")).select("s_suppkey", "field", "value", F.when(F.col("n") < len(fields), "partial").otherwise("parsed").alias("status"))
