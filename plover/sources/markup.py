"""XML, JSON and HTML sources as rows: filings, patents, papers, feeds, tables and disclosures.

A text or file is a row; Arrow UDFs turn its markup into arrays of structs and
everything after that are DataFrame functions. Markup that can't be read gives
an empty array.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = "array<struct<name:string,context:string,value:string>>"
PATENT = "array<struct<number:string,family:string,title:string,abstract:string,applicants:array<string>,ipc:array<string>,cpc:array<string>,citations:array<string>,claims:int,published:string,priority:string>>"
PAPER = "array<struct<source_id:string,title:string,abstract:string,authors:array<string>,published:string,doi:string,journal:string,categories:array<string>,url:string,pdf_url:string>>"
FAMILY = "struct<members:array<string>,countries:array<string>,status:string>"


def _of_each(read: Callable, kind: str) -> Callable[[Column], Column]:
    def apply(column: Column) -> Column:
        arrow = _arrow(T._parse_datatype_string(kind))  # needs a session, which tasks lack

        def run(values: pa.Array) -> pa.Array:
            return pa.array([read(v) for v in values.to_pylist()], arrow)

        return F.arrow_udf(run, kind)(column)

    return apply


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64()}[type(kind)]


def _tree(content: str | bytes | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(content) if content else None
    except (ElementTree.ParseError, ValueError):
        return None


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _words(node: ElementTree.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _all(node: ElementTree.Element, *path: str) -> Iterator[ElementTree.Element]:
    return iter(node.findall(".//" + "//".join(f"{{*}}{p}" for p in path)))


def _first(node: ElementTree.Element, *path: str) -> str:
    return next((w for x in _all(node, *path) if (w := _words(x))), "")


# Filings


def _facts(content: bytes | str | None) -> list[dict]:
    """Facts of an XBRL instance, or of all instances in a zip file."""
    if isinstance(content, bytes) and content[:2] == b"PK":
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as files:
                names = [n for n in files.namelist() if re.search(r"(xbrl|publicdoc).*\.(xbrl|xml)$|\.xbrl$", n.lower())]
                return [fact for n in names for fact in _facts(files.read(n))]
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
            return []
    root = _tree(content)
    found = [] if root is None else [(n, n.get("contextRef")) for n in root.iter() if n.get("contextRef")]
    return [{"name": _name(n), "context": c, "value": _words(n)} for n, c in found if _words(n)]


xbrl_facts = _of_each(_facts, FACT)


def context_priority(context: Column, own: bool = False) -> Column:
    """How well a context suits a field; ``own``: the company's own figure is wanted, not the group's."""
    low = F.lower(F.coalesce(context, F.lit("")))
    alone = low.contains("nonconsolidated") | low.contains("non_consolidated")
    group, member = low.contains("consolidated") & ~alone, low.contains("_") | low.contains("member")
    points = lambda rule, n: F.when(rule, n).otherwise(0)
    # Fixed values.
    score = points(low.contains("current"), 50) + points(low.contains("duration"), 30) + points(low.contains("instant"), 10) - points(low.contains("filingdate"), 20)
    if own:
        return score + F.when(alone, 16).when(group, -4).otherwise(0)
    segment = low.contains("reportablesegment") | low.contains("operatingsegments") | low.contains("reconcilingitems")
    return score + points(~member, 20) + points(group, 10) - points(alone, 12) - points(member, 10) - points(segment, 12) + points(low.contains("totalofreportablesegments"), 4)


def resolved_facts(filings: DataFrame, key: str, content: str, fields: dict[str, list[str]], own: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, value): of each filing and field the fact whose context suits best, the first of equal ones.

    ``fields`` gives the element names of each field; ``own`` those for which the company's own figure is wanted.
    """
    known = F.create_map(*[F.lit(x) for name, tags in fields.items() for tag in tags for x in (tag, name)])
    rows = filings.select(key, F.posexplode(xbrl_facts(F.col(content))).alias("at", "f")).withColumn("field", F.try_element_at(known, F.col("f.name"))).filter("field is not null")
    rank = F.when(F.col("field").isin(list(own)), context_priority(F.col("f.context"), True)).otherwise(context_priority(F.col("f.context")))
    return rows.groupBy(key, "field").agg(F.max_by("f.value", F.struct(rank, -F.col("at"))).alias("value"))


# Tables of employees


def cell_texts(html: Column) -> Column:
    """The texts of all cells of a table that aren't empty."""
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.filter(F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))), lambda c: c != "")


def employee_table(html: Column) -> Column:
    """STRUCT<employees, service_years, salary> of a table with a header row and a row of values.

    Values stand as far from the first value as their headers from the first
    header; salaries in thousands are scaled, and implausible values are null.
    """
    number = lambda c: F.regexp_replace(F.regexp_extract(c, r"-?[\d,]+(?:\.\d+)?", 0), ",", "").try_cast("double")
    heads = {"employees": "従業員数", "service_years": "平均勤続年数", "salary": "平均年間給与"}

    def placed(cells: Column) -> Column:
        holds = lambda word: F.transform(cells, lambda c: c.contains(word))
        return F.struct(cells.alias("cells"), *[F.array_position(holds(word), True).alias(name) for name, word in heads.items()])

    def begun(x: Column) -> Column:
        return F.struct(x.alias("x"), F.array_min(F.filter(F.array(*[x[name] for name in heads]), lambda k: k > 0)).alias("begin"))

    def rowed(x: Column) -> Column:
        is_value = F.transform(x["x"]["cells"], lambda c, k: (k + 1 > x["begin"]) & number(c).isNotNull() & ~c.rlike("従業員|平均|給与|年齢|勤続|増減率|令和|現在"))
        return F.struct(x["x"].alias("x"), x["begin"].alias("begin"), F.array_position(is_value, True).alias("row"))

    def valued(x: Column) -> Column:
        cells, row, begin = x["x"]["cells"], x["row"], x["begin"]
        value = {name: F.when((x["x"][name] > 0) & (row > 0), number(F.try_element_at(cells, (row + x["x"][name] - begin).cast("int")))) for name in heads}
        salary = value["salary"] * F.when(F.try_element_at(cells, F.nullif(x["x"]["salary"], F.lit(0)).cast("int")).contains("千円"), 1000).otherwise(1)
        return F.struct(value["employees"].alias("employees"), value["service_years"].alias("service_years"), salary.alias("salary"))

    def plausible(x: Column) -> Column:
        return F.struct(x["employees"].alias("employees"), F.when(x["service_years"] <= 60, x["service_years"]).alias("service_years"), F.when(x["salary"] >= 100_000, x["salary"]).alias("salary"))

    cells = F.filter(cell_texts(html), lambda c: ~c.rlike(r"^[\[〔（(].*[\]〕）)]$"))
    # Each step is an element that the next reads: as expressions put into each other, the page would be parsed anew for each cell.
    out = F.array(cells)
    for step in (placed, begun, rowed, valued, plausible):
        out = F.transform(out, step)
    return out[0]


# Patents


def _english(nodes: Iterator[ElementTree.Element]) -> list[str]:
    texts = [(next((v for k, v in n.attrib.items() if k.rpartition("}")[2] == "lang"), ""), w) for n in nodes if (w := _words(n))]
    return [w for lang, w in texts if lang.startswith("en")] or [w for _, w in texts]


def _number(reference: ElementTree.Element | None) -> tuple[str, str]:
    """(country, number and kind as one word; date) of the best document id below a reference."""
    ids = [] if reference is None else sorted(_all(reference, "document-id"), key=lambda d: {"docdb": 0, "epodoc": 1}.get(d.get("document-id-type"), 2))
    parts = [("".join(_first(d, k) for k in ("country", "doc-number", "kind")), _first(d, "date")) for d in ids]
    return next((n for n, _ in parts if n), ""), next((d for _, d in parts if d), "")


def _codes(document: ElementTree.Element) -> tuple[list[str], list[str]]:
    plain = lambda text: re.sub(r"\s+", "", text.upper())
    ipc = {plain(_words(x)) for kind in ("classification-ipcr", "classification-ipc") for x in _all(document, kind, "text")}
    cpc = set()
    for x in _all(document, "patent-classification"):
        level = {k: _first(x, k) for k in ("section", "class", "subclass", "main-group", "subgroup")}
        code = plain(level["section"] + level["class"] + level["subclass"] + (f"{level['main-group']}/{level['subgroup']}" if level["main-group"] else ""))
        scheme = next(iter(_all(x, "classification-scheme")), None)
        (cpc if scheme is not None and "CPC" in (scheme.get("scheme") or scheme.get("office") or "").upper() else ipc).add(code)
    return sorted(ipc - {""}), sorted(cpc - {""})


def _patents(content: str | None) -> list[dict]:
    root, out = _tree(content), []
    for d in [] if root is None else _all(root, "exchange-document"):
        (ipc, cpc), priorities = _codes(d), [_number(p) for p in _all(d, "priority-claim")]
        out.append({
            "number": f"{d.get('country', '')}{d.get('doc-number', '')}{d.get('kind', '')}", "family": d.get("family-id"), "title": next(iter(_english(_all(d, "invention-title"))), ""),
            "abstract": " ".join(_english(_all(d, "abstract"))), "applicants": list(dict.fromkeys(w for x in _all(d, "applicant", "name") if (w := _words(x)))), "ipc": ipc, "cpc": cpc,
            "citations": list(dict.fromkeys(n for x in _all(d, "references-cited", "patcit") if (n := _number(x)[0] or re.sub("[^0-9A-Z]", "", x.get("dnum", "").upper())))),
            "claims": len(d.findall(".//{*}claims/{*}claim")), "published": _number(d.find(".//{*}publication-reference"))[1], "priority": min((p[1] for p in priorities if p[1]), default=""),
        })
    return out


def _family(content: str | None) -> dict:
    """Members and countries of a family, and the state that its legal events tell of."""
    root = _tree(content)
    members = [] if root is None else list(dict.fromkeys(n for m in root.findall(".//{*}family-member") if (n := _number(m.find("./{*}publication-reference"))[0])))
    said = [] if root is None else [f"{x.get('code', '')} {x.get('desc', '')} {_words(x)}".upper() for x in _all(root, "legal")]
    # Fixed values.
    ended, granted = r"REVOK|LAPSE|CEASE|EXPIRE|WITHDRAW|REFUS", r"GRANT|PATENTED"
    status = "inactive" if re.search(ended, " ".join(said)) else "granted" if re.search(granted, " ".join(said)) else "active_or_unknown" if said else ""
    return {"members": members, "countries": sorted({m[:2] for m in members if m[:2].isalpha()}), "status": status}


patent_records = _of_each(_patents, PATENT)
patent_family = _of_each(_family, FAMILY)


# Papers


def _arxiv(content: str | None) -> list[dict]:
    root, out = _tree(content), []
    for e in [] if root is None else _all(root, "entry"):
        url = _first(e, "id")
        out.append({
            "source_id": re.sub(r"v\d+$", "", url.rstrip("/").rpartition("/")[2]), "title": _first(e, "title"), "abstract": _first(e, "summary"), "authors": [w for a in _all(e, "author", "name") if (w := _words(a))],
            "published": _first(e, "published"), "doi": _first(e, "doi"), "journal": _first(e, "journal_ref"), "categories": [c.get("term", "") for c in _all(e, "category")], "url": url,
            "pdf_url": next((x.get("href", "") for x in _all(e, "link") if x.get("type") == "application/pdf"), ""),
        })
    return out


def _jstage(content: str | None) -> list[dict]:
    """Entries of a bilingual feed, Japanese first; one that reports an error has none."""
    root, out = _tree(content), []
    if root is None or _first(root, "status") not in ("", "0"):
        return []
    for e in _all(root, "entry"):
        text = lambda *path: _first(e, path[0], "ja", *path[1:]) or _first(e, path[0], "en", *path[1:]) or _first(e, path[0])  # noqa: B023, E731
        authors = [w for a in _all(e, "author") for x in (next((y for y in a if _name(y) == "ja"), None) or next((y for y in a if _name(y) == "en"), a)).iter() if _name(x) == "name" and (w := _words(x))]
        one = {"title": text("article_title"), "url": text("article_link"), "doi": _first(e, "doi"), "journal": text("material_title"), "authors": list(dict.fromkeys(authors)), "published": _first(e, "pubyear"), "abstract": "", "categories": [], "pdf_url": ""}
        one["source_id"] = one["doi"] or _first(e, "joi") or one["url"] or one["title"]
        out += [one] if one["title"] else []
    return out


arxiv_entries = _of_each(_arxiv, PAPER)
jstage_entries = _of_each(_jstage, PAPER)

OPENALEX = (
    "id string, title string, display_name string, doi string, publication_date string, ids struct<doi:string,arxiv:string>, abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>, best_oa_location struct<pdf_url:string>, "
    "locations array<struct<pdf_url:string>>, topics array<struct<display_name:string,subfield:struct<display_name:string>,field:struct<display_name:string>>>"
)


def openalex_papers(lines: DataFrame, text: str) -> DataFrame:
    """One paper per line of JSON; the abstract is put together from its inverted index."""
    w = lines.select(F.from_json(text, OPENALEX).alias("w")).filter("w.id is not null")
    tail = lambda c: F.regexp_extract(c, r"([^/]*)/*$", 1)
    places = F.flatten(F.transform(F.map_entries("w.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    names = lambda xs, pick: F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array()), pick), lambda x: F.coalesce(x, F.lit("")) != ""))
    topics = F.array_distinct(F.filter(F.flatten(F.transform(F.col("w.topics"), lambda t: F.array(t["display_name"], t["subfield"]["display_name"], t["field"]["display_name"]))), lambda x: x.isNotNull()))
    return w.select(
        tail(F.col("w.id")).alias("source_id"), F.trim(F.coalesce("w.title", "w.display_name", F.lit(""))).alias("title"), F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["word"]), " "), F.lit("")).alias("abstract"),
        names(F.col("w.authorships"), lambda a: F.trim(a["author"]["display_name"])).alias("authors"), F.col("w.publication_date").alias("published"), F.coalesce("w.doi", "w.ids.doi", F.lit("")).alias("doi"),
        tail(F.coalesce("w.ids.arxiv", F.lit(""))).alias("arxiv_id"), F.coalesce("w.primary_location.source.display_name", F.lit("")).alias("journal"), F.coalesce(topics, F.array()).alias("categories"),
        F.coalesce("w.primary_location.landing_page_url", "w.doi", "w.id").alias("url"), F.coalesce("w.best_oa_location.pdf_url", F.try_element_at(names(F.col("w.locations"), lambda x: x["pdf_url"]), F.lit(1)), F.lit("")).alias("pdf_url"),
    )


# Disclosures and n-gram files


def disclosures(pages: DataFrame, html: str, code: str, fallback: str, keywords: tuple[str, ...], host: str, folder: str) -> DataFrame:
    """(code, day, title, url): rows of tables that name the page's code and hold a keyword, one per day and title."""
    rows = pages.select(F.col(code).alias("code"), F.col(fallback).alias("fallback"), F.explode(F.split(html, r"(?i)</tr>|\n")).alias("row"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("row", "<[^>]*>", " "), r"\s+", " "))
    rows = rows.withColumn("plain", plain).filter(F.col("row").contains(F.col("code")) & F.col("plain").rlike("|".join(map(re.escape, keywords))))
    title = F.trim(F.regexp_extract("plain", rf"([^。\s]*(?:{'|'.join(map(re.escape, keywords))})[^。]*)", 1))
    date = [F.regexp_extract("plain", r"(20\d{2}|19\d{2})[/-](\d{1,2})[/-](\d{1,2})", k) for k in (1, 2, 3)]
    day = F.coalesce(F.try_make_timestamp(*[d.try_cast("int") for d in date], F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.col("fallback"))
    link = F.regexp_extract("row", r"href=['\"]([^'\"]+)['\"]", 1)
    url = F.when((link == "") | link.startswith("http"), link).when(link.startswith("/"), F.concat(F.lit(host), link)).otherwise(F.concat(F.lit(folder + "/"), F.regexp_replace(link, r"^[./]+", "")))
    return rows.groupBy("code", day.alias("day"), title.alias("title")).agg(F.min(url).alias("url"))


def quadgram_documents(grams: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(stamp, doc_id, n_grams, hits): documents of n-gram files with the terms that they hold.

    Counts only are kept for each document, not its n-grams.
    """
    held = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.concat(F.lit(" "), F.lower("gram"), F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))
    return grams.groupBy("stamp", "doc_id").agg(F.count(F.lit(1)).alias("n_grams"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(held)))).alias("hits"))
