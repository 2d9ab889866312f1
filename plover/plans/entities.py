"""Queries on entities: novelty against a history, aliases in texts, identities of papers, companies by name and address."""

from __future__ import annotations

from pyspark.sql import functions as F

from plover.operators import aliases, candidates, identity, novelty
from plover.operators import text as tx
from plover.plans.registry import query

_ITEMS_SQL = """known AS (SELECT 'Brand#' || n_nationkey AS maker FROM nation WHERE n_regionkey < 4),
items AS (SELECT p_partkey AS key, maker AS grp, lower(p_name || p_type) AS s, [p_type] AS codes, string_split(p_name, ' ') AS more FROM part LEFT JOIN known ON maker = p_brand)"""


def _makers(t):
    return t.nation.filter("n_regionkey < 4").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("maker"))


@query("n03_novelty", f"""WITH {_ITEMS_SQL},
g AS (SELECT key, substr(s, i::INT, 3) AS gram, count(*) AS cnt FROM (SELECT key, regexp_replace(s, '\\s', '', 'g') AS s FROM items), unnest(range(1, length(s) - 1)) u(i) GROUP BY ALL),
norms AS (SELECT key, sqrt(sum(cnt*cnt)) AS norm FROM g GROUP BY key),
pairs AS (SELECT a.key, b.key AS other FROM items a JOIN items b ON a.grp = b.grp AND b.key < a.key),
dots AS (SELECT p.key, other, sum(x.cnt*y.cnt) AS dot FROM pairs p JOIN g x ON x.key = p.key JOIN g y ON y.key = other AND y.gram = x.gram GROUP BY 1, 2),
near AS (SELECT p.key, least(max(coalesce(dot/(na.norm*nb.norm), 0)), 1) AS near FROM pairs p LEFT JOIN dots d ON d.key = p.key AND d.other = p.other LEFT JOIN norms na ON na.key = p.key LEFT JOIN norms nb ON nb.key = p.other GROUP BY p.key),
history AS (SELECT grp, key, substr(regexp_replace(upper(unnest(codes)), '[^A-Z0-9]', '', 'g'), 1, 4) AS root FROM items WHERE grp IS NOT NULL),
asked AS (SELECT DISTINCT grp, key, root FROM (SELECT grp, key, substr(regexp_replace(upper(unnest(codes || more)), '[^A-Z0-9]', '', 'g'), 1, 4) AS root FROM items WHERE grp IS NOT NULL) WHERE root <> ''),
fresh AS (SELECT key, count(*) AS fresh FROM asked a WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.grp = a.grp AND h.root = a.root AND h.key < a.key) GROUP BY key)
SELECT i.key, round(near, 6) AS near, coalesce(fresh, 0) AS fresh,
    round(CASE WHEN grp IS NULL THEN 25 WHEN near IS NULL THEN 50 ELSE greatest(0, least(100, 75*(1 - near) + least(25, 10*coalesce(fresh, 0)))) END, 6) AS novelty
FROM items i LEFT JOIN near USING (key) LEFT JOIN fresh USING (key)""")  # fmt: skip
def n03(t):
    """Each part against all earlier parts of its maker; parts of makers that aren't known have no history."""
    rows = t.part.join(_makers(t), F.col("maker") == F.col("p_brand"), "left")
    items = rows.select(F.col("p_partkey").alias("key"), F.col("maker").alias("group"), F.array("p_type").alias("codes"), F.split("p_name", " ").alias("more_codes"))
    grams = tx.char_grams(t.part, "p_partkey", F.concat("p_name", "p_type")).withColumnRenamed("p_partkey", "key")
    return novelty.novelty(items, grams)


_ALIASES_SQL = r"""sites AS (SELECT DISTINCT regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS company, lower(regexp_extract(html, '<title>([A-Za-z]{6,})', 1)) AS word FROM pages),
named AS (SELECT DISTINCT * FROM (SELECT company, company AS alias, 1 AS rank FROM sites UNION ALL SELECT company, regexp_extract(company, '([a-z]{5,})\.example', 1), 2 FROM sites UNION ALL SELECT company, word, 3 FROM sites) WHERE alias <> '')"""


def _site_aliases(t):
    """Aliases of the sites in `pages`: the host, its own label, the first words of its pages' titles."""
    host = F.regexp_extract(F.lower("url"), "^https?://([^/:?#]+)", 1)
    sites = t.pages.select(host.alias("company"), F.lower(F.regexp_extract("html", "<title>([A-Za-z]{6,})", 1)).alias("word"))
    names = [F.struct(F.col("company").alias("alias"), F.lit(1).alias("rank")), F.struct(F.regexp_extract("company", r"([a-z]{5,})\.example", 1).alias("alias"), F.lit(2).alias("rank")), F.struct(F.col("word").alias("alias"), F.lit(3).alias("rank"))]
    return sites.select("company", F.explode(F.array(*names)).alias("a")).select("company", "a.alias", "a.rank").filter("alias <> ''").distinct()


@query("j31_title_holds_alias", f"""WITH {_ALIASES_SQL}
SELECT doc_id, company, alias FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN named ON contains(t, alias)
QUALIFY row_number() OVER (PARTITION BY doc_id, company ORDER BY rank, alias) = 1""")
def j31(t):
    return aliases.alias_matches(t.documents, _site_aliases(t), "doc_id", "text").select(F.col("key").alias("doc_id"), "company", "alias")


_TERMS_SQL = "asked AS (SELECT DISTINCT item_id, lower(regexp_extract(text, '^([A-Za-z]{3,})', 1)) AS term FROM benchmark)"


@query("j32_terms_and_aliases", rf"""WITH {_ALIASES_SQL}, {_TERMS_SQL},
words AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS word FROM documents),
hits AS (SELECT doc_id, count(DISTINCT item_id) AS queries FROM words JOIN asked ON term = word WHERE term <> '' AND (term NOT LIKE 'th%' OR lang = 'en') GROUP BY doc_id),
firms AS (SELECT doc_id, company, alias FROM words JOIN named ON alias = word WHERE rank > 1 QUALIFY row_number() OVER (PARTITION BY doc_id, company ORDER BY rank, alias) = 1)
SELECT doc_id, queries, company, alias FROM hits JOIN firms USING (doc_id)""")
def j32(t):
    """Texts that hold a query's term, in the query's language if it has one, with the companies that they name; whole ASCII words."""
    terms = t.benchmark.select("item_id", F.lower(F.regexp_extract("text", "^([A-Za-z]{3,})", 1)).alias("term"))
    terms = terms.withColumn("language", F.when(F.col("term").startswith("th"), "en"))
    hits, numbered = aliases.pattern_hits(t.documents, terms, ["item_id"], "doc_id", "text", "term", whole_words=True)
    met = hits.join(numbered.select(F.col("place").alias("n_place"), "item_id", "language"), F.col("place") == F.col("n_place"))
    met = met.join(t.documents.select("doc_id", "lang"), F.col("key") == F.col("doc_id")).filter("language is null or language = lang")
    queries = met.groupBy("doc_id").agg(F.countDistinct("item_id").alias("queries"))
    firms = aliases.alias_matches(t.documents, _site_aliases(t).filter("rank > 1"), "doc_id", "text", whole_words=True)
    return queries.join(firms, F.col("doc_id") == F.col("key")).select("doc_id", "queries", "company", "alias")


@query("e42_articles_with_matches", f"""WITH {_ALIASES_SQL},
articles AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS domain, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages),
found AS (SELECT page_id, company, alias, rank FROM articles JOIN named ON contains(lower(title), alias) QUALIFY row_number() OVER (PARTITION BY page_id, company ORDER BY rank, alias) = 1),
listed AS (SELECT page_id, count(*) AS companies, to_json(list({{'company': company, 'alias': alias}} ORDER BY rank, company, alias))::VARCHAR AS matches FROM found GROUP BY page_id)
SELECT page_id, domain, title, coalesce(companies, 0) AS companies, coalesce(matches, '[]') AS matches FROM articles LEFT JOIN listed USING (page_id)""")
def e42(t):
    """Articles with the companies that their titles name embedded, in the aliases' order."""
    host = F.regexp_extract(F.lower("url"), "^https?://([^/:?#]+)", 1)
    articles = t.pages.select("page_id", host.alias("domain"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    found = aliases.alias_matches(articles, _site_aliases(t), "page_id", "title")
    listed = found.groupBy("key").agg(F.count(F.lit(1)).alias("companies"), F.array_sort(F.collect_list(F.struct("place", F.struct("company", "alias").alias("m")))).alias("all"))
    listed = listed.select("key", "companies", F.to_json(F.transform("all", lambda x: x["m"])).alias("matches"))
    met = articles.join(listed, F.col("page_id") == F.col("key"), "left")
    return met.select("page_id", "domain", "title", F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("matches", F.lit("[]")).alias("matches"))


_PAPERS_SQL = r"""papers AS (SELECT doc_id AS rec, source, lang || ':' || n_chars AS source_id, lower(trim(regexp_replace(lower(substr(text, 1, 60)), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS title, lang AS author, text AS abstract,
    CASE WHEN substr(sha256(text), 1, 1) < '8' THEN '10.5555/' || substr(sha256(substr(text, 1, 120)), 1, 16) ELSE '' END AS doi,
    CASE WHEN substr(sha256(text), 2, 1) < '6' AND length(text) > 240 THEN substr(sha256(substr(text, 121, 120)), 1, 10) ELSE '' END AS arxiv,
    CASE WHEN substr(sha256(text), 3, 1) < '8' THEN source ELSE '' END AS journal, strftime(DATE '2020-01-01' + (n_chars % 1000)::INT, '%Y-%m-%d') AS updated_at FROM documents)"""


def _papers(t):
    digest = F.sha2("text", 256)
    part = lambda c, a, b: F.substring(c, a, b)
    return t.documents.select(
        F.col("doc_id").alias("rec"), "source", F.concat("lang", F.lit(":"), F.col("n_chars").cast("string")).alias("source_id"), part("text", 1, 60).alias("title"), F.col("lang").alias("author"), F.col("text").alias("abstract"),
        F.when(part(digest, 1, 1) < "8", F.concat(F.lit("https://doi.org/10.5555/"), part(F.sha2(part("text", 1, 120), 256), 1, 16))).otherwise("").alias("doi"),
        F.when((part(digest, 2, 1) < "6") & (F.length("text") > 240), F.concat(F.lit("arXiv:"), part(F.sha2(part("text", 121, 120), 256), 1, 10), F.lit("v2"))).otherwise("").alias("arxiv"),
        F.when(part(digest, 3, 1) < "8", F.col("source")).otherwise("").alias("journal"), F.date_format(F.expr("date_add(date'2020-01-01', cast(n_chars % 1000 as int))"), "yyyy-MM-dd").alias("updated_at"),
    )


@query("d08_cross_source_merge", f"""WITH RECURSIVE {_PAPERS_SQL},
keyed AS (SELECT rec, 's' || source || chr(31) || source_id AS key, true AS own FROM papers UNION ALL SELECT rec, 'd' || doi, true FROM papers WHERE doi <> '' UNION ALL SELECT rec, 'a' || arxiv, true FROM papers WHERE arxiv <> ''
    UNION ALL SELECT rec, 't' || title || chr(31) || author, doi = '' AND arxiv = '' FROM papers WHERE author <> ''),
firsts AS (SELECT key, min(rec) AS first FROM keyed GROUP BY key),
edges AS (SELECT DISTINCT rec AS a, first AS b FROM keyed JOIN firsts USING (key) WHERE own AND first < rec),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(rec, root) AS (SELECT rec, rec FROM papers UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.rec WHERE r.root < e.b),
roots AS (SELECT rec, min(root) AS root FROM reach GROUP BY rec),
met AS (SELECT * FROM papers JOIN roots USING (rec))
SELECT root, CASE WHEN arg_min(doi, rec) <> '' THEN 'doi:' || arg_min(doi, rec) WHEN arg_min(arxiv, rec) <> '' THEN 'arxiv:' || arg_min(arxiv, rec) ELSE 'paper:' || substr(sha256(arg_min(title, rec) || '|' || arg_min(author, rec)), 1, 32) END AS paper_id,
    count(*) AS records, count(DISTINCT source || chr(31) || source_id) AS source_records, coalesce(arg_min(doi, rec) FILTER (doi <> ''), '') AS doi, coalesce(arg_min(arxiv, rec) FILTER (arxiv <> ''), '') AS arxiv,
    max(length(abstract)) AS abstract_chars, coalesce(arg_min(journal, rec) FILTER (journal <> ''), '') AS journal, max(updated_at) AS updated_at
FROM met GROUP BY root""")  # fmt: skip
def d08(t):
    merged = identity.merge_papers(identity.resolve_identities(_papers(t)))
    return merged.select("root", "paper_id", "records", "source_records", "doi", "arxiv", F.length("abstract").alias("abstract_chars"), "journal", "updated_at")


@query("j04_j05_candidates_with_margin", r"""WITH jobs AS (SELECT c_custkey AS key, CASE WHEN c_acctbal < 9000 THEN p_name || ' ' || substr(p_size::VARCHAR, 1, 1) ELSE c_name END AS company, p_brand AS location, CASE WHEN c_acctbal < 0 THEN lpad(c_custkey::VARCHAR, 13, '9') END AS number FROM customer JOIN part ON p_partkey = c_custkey),
keys AS (SELECT *, lower(replace(replace(company, ' ', ''), '-', '')) AS j, lower(replace(replace(location, ' ', ''), '-', '')) AS a FROM jobs),
master AS (SELECT p_partkey AS number, p_name || ' ' || p_size AS company, p_brand || ' ' || p_type AS address, lower(replace(replace(p_name || ' ' || p_size, ' ', ''), '-', '')) AS m, lower(replace(replace(p_brand || ' ' || p_type, ' ', ''), '-', '')) AS b FROM part),
met AS (SELECT key, m.number, m.company, m.address, CASE WHEN j = m THEN 1.0::DOUBLE ELSE 0.82::DOUBLE END AS name_score,
    CASE WHEN contains(b, a) OR contains(a, b) THEN 1.0::DOUBLE WHEN len(list_filter(range(1, length(a) - 4), lambda i: contains(b, substr(a, i, 6)))) > 0 THEN least(6.0::DOUBLE/length(a), 1) WHEN len(list_filter(range(1, length(a) - 3), lambda i: contains(b, substr(a, i, 5)))) > 0 THEN least(5.0::DOUBLE/length(a), 1)
        WHEN len(list_filter(range(1, length(a) - 2), lambda i: contains(b, substr(a, i, 4)))) > 0 THEN least(4.0::DOUBLE/length(a), 1) WHEN len(list_filter(range(1, length(a) - 1), lambda i: contains(b, substr(a, i, 3)))) > 0 THEN least(3.0::DOUBLE/length(a), 1) ELSE 0.0::DOUBLE END AS place
    FROM keys k JOIN master m ON contains(m.m, k.j) OR contains(k.j, m.m) WHERE k.number IS NULL),
scored AS (SELECT key, number, company, address, round(name_score*0.75::DOUBLE + place*0.25::DOUBLE, 3) AS confidence, name_score, round(place, 3) AS address_score FROM met),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, number) AS n FROM scored),
best AS (SELECT key, count(*) AS candidates, max(number) FILTER (n = 1) AS top, max(confidence) AS best, coalesce(max(confidence) FILTER (n = 2), 0) AS second,
    to_json(list({'number': number, 'company': company, 'address': address, 'confidence': confidence, 'name_score': name_score, 'address_score': address_score} ORDER BY n) FILTER (n <= 5))::VARCHAR AS shown FROM ranked GROUP BY key)
SELECT k.key, CASE WHEN k.number IS NOT NULL THEN 'already_present' WHEN best IS NULL THEN 'not_found' WHEN best >= 0.92 AND round(best - second, 6) >= 0.05 THEN 'estimated' ELSE 'ambiguous' END AS status,
    CASE WHEN k.number IS NOT NULL THEN k.number WHEN best >= 0.92 AND round(best - second, 6) >= 0.05 THEN top::VARCHAR END AS number, CASE WHEN k.number IS NOT NULL THEN 1.0 ELSE best END AS confidence, coalesce(candidates, 0) AS candidates, shown
FROM keys k LEFT JOIN best b ON b.key = k.key""")  # fmt: skip
def j05(t):
    """Customers as jobs, parts as the master of companies: equal or contained names, weighed with the places."""
    rows = t.customer.join(t.part, F.col("p_partkey") == F.col("c_custkey"))
    name = F.when(F.col("c_acctbal") < 9000, F.concat_ws(" ", "p_name", F.substring(F.col("p_size").cast("string"), 1, 1))).otherwise(F.col("c_name"))
    number = F.when(F.col("c_acctbal") < 0, F.lpad(F.col("c_custkey").cast("string"), 13, "9"))
    jobs = rows.select(F.col("c_custkey").alias("key"), name.alias("company"), F.col("p_brand").alias("location"), number.alias("number"))
    master = t.part.select(F.col("p_partkey").alias("number"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("company"), F.concat_ws(" ", "p_brand", "p_type").alias("address"))
    return candidates.resolve_numbers(jobs, master)
