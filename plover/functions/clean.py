"""Column functions that clean raw text: numbers, money, names, keys, URLs and dates.

All of them give null for what cannot be read and never raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plover.functions.unicode import nfkc

FULL_DIGITS = "０１２３４５６７８９"
DIGITS = "0123456789"
#: Japanese units of money; fixed values.
LARGE_UNITS = {"兆": 1e12, "億": 1e8, "万": 1e4}


def number(text: Column) -> Column:
    return text.try_cast("double")


def corporate_number(raw: Column) -> Column:
    """Digits in ASCII without spaces, hyphens or a trailing ``.0``; null becomes empty."""
    plain = F.regexp_replace(F.translate(F.trim(F.coalesce(raw, F.lit(""))), FULL_DIGITS, DIGITS), r"[\s\-ー－]", "")
    return F.regexp_replace(plain, r"\.0$", "")


def first_number(raw: Column) -> Column:
    """The first decimal number, commas ignored."""
    return number(F.regexp_extract(F.regexp_replace(raw, ",", ""), r"-?\d+(?:\.\d+)?", 0))


def amount_with_unit(raw: Column) -> Column:
    """The first number, times a million for 百万円 or a thousand for 千円."""
    scale = F.when(raw.contains("百万円"), 1e6).when(raw.contains("千円"), 1e3).otherwise(1.0)
    return first_number(F.translate(raw, FULL_DIGITS + "．，", DIGITS + ".,")) * scale


def japanese_money(raw: Column) -> Column:
    """Sum of numbers with 兆, 億 or 万, then times the unit 百万円 or 千円."""
    text = F.regexp_replace(raw, r"[\s,，]", "")
    pattern = F.lit(r"([0-9]+(?:\.[0-9]+)?)(兆|億|万)?")
    values, units = F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2)
    unit = lambda u: F.when(u == "兆", 1e12).when(u == "億", 1e8).when(u == "万", 1e4).otherwise(1.0)
    total = F.aggregate(F.zip_with(values, units, lambda v, u: number(v) * unit(u)), F.lit(0.0), lambda a, x: a + x)
    scale = F.when(text.contains("百万円"), 1e6).when(text.contains("千円"), 1e3).otherwise(1.0)
    return F.when((F.size(values) > 0) & ~text.isin("", "-", "—"), total * scale)


def suffixed_number(raw: Column) -> Column:
    """One number with at most one of 兆, 億, 万; units and signs such as % are dropped."""
    text = F.trim(raw)
    scale = F.when(text.contains("兆"), 1e12).when(text.contains("億"), 1e8).when(text.contains("万円") | text.endswith("万"), 1e4).otherwise(1.0)
    return number(F.trim(F.regexp_replace(text, "時間|[,円万億兆%歳年]", ""))) * scale


def ledger_number(raw: Column) -> Column:
    """Accounting notation: brackets are negative, % is a hundredth, spreadsheet errors are null."""
    text = F.regexp_replace(F.trim(raw), r"[,\s]", "")
    negative = text.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(text, r"[()%兆億万円]", "")
    scale = F.when(text.contains("兆"), 1e12).when(text.contains("億"), 1e8).when(text.contains("万"), 1e4).otherwise(1.0)
    value = number(bare) * scale * F.when(text.contains("%"), 0.01).otherwise(1.0)
    return F.when(~text.startswith("#"), F.when(negative, -value).otherwise(value))


def one_line(raw: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))


def match_key(raw: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(raw), r"[^a-z0-9]", "")


def legal_name_key(raw: Column) -> Column:
    """A company's name without legal forms, spaces and punctuation, in lower case."""
    plain = F.regexp_replace(F.lower(raw), r"\b(inc|corp|co|ltd|llc|plc|corporation|company|limited)\b\.?", "")
    return F.regexp_replace(F.regexp_replace(plain, "株式会社|有限会社|合同会社|（株）|\\(株\\)", ""), r"[\s.,&#'\-]", "")


def ticker(raw: Column, suffix: str = ".T") -> Column:
    """Four digits (and perhaps a letter or a check digit) get the market's suffix; others go to upper case."""
    text = F.upper(F.trim(raw))
    return F.when(text.rlike(r"^[0-9]{3}[0-9A-Z]0?$"), F.concat(F.substring(text, 1, 4), F.lit(suffix))).otherwise(text)


def doi(raw: Column) -> Column:
    """A bare lower-case DOI; null if there is none."""
    text = F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(text.rlike(r"^10\.\d+/"), text)


def arxiv_id(raw: Column) -> Column:
    """An arXiv identifier without prefix, path and version."""
    text = F.regexp_replace(F.lower(F.trim(raw)), r"^(https?://arxiv\.org/(abs|pdf)/|arxiv:)", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"\.pdf$", ""), r"v\d+$", ""), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    """The host without ``www.`` and port."""
    return F.regexp_replace(F.regexp_replace(url_host(url), r":\d+$", ""), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no ``utm_`` parameters, no fragment."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(text, r"\?(.*)$", 1), "&"), lambda p: ~F.lower(p).startswith("utm_") & (p != ""))
    return F.concat(scheme, F.lit("://"), url_host(text), path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def flexible_date(raw: Column) -> Column:
    """``yyyyMMdd``, ``yyyy-MM-dd`` or ``yyyy/MM/dd`` at the start of the text."""
    text = F.trim(raw)
    iso = F.regexp_replace(F.substring(text, 1, 10), "/", "-")
    compact = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    return F.coalesce(compact, F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso)).try_cast("date")


def stable_id(*parts: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def ratio(top: Column, bottom: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(bottom > 0, top / bottom)


def change(new: Column, old: Column) -> Column:
    """Relative change against the size of the old value; null if it is zero."""
    return F.try_divide(new - old, F.abs(old))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def present(raw: Column) -> Column:
    """Whether the text says yes: a known word or a positive number."""
    text = F.lower(F.trim(raw))
    return F.coalesce(text.isin("あり", "有", "○", "yes", "true"), F.lit(False)) | F.coalesce(number(text) > 0, F.lit(False))


def mean_of(*values: Column) -> Column:
    """The mean of the values that aren't null."""
    known = F.array_compact(F.array(*values))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def flags(**rules: Column) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


#: Legal forms and words that news names are compared without (fixed values).
NEWS_FORMS = "株式会社|有限会社|ホールディングス|holdings?|corporation|corp\\.?|inc\\.?|ltd\\.?"
#: Forms that the enrichment files' names are compared without, in capitals (fixed values).
ENRICHMENT_FORMS = ("株式会社", "有限会社", "合同会社", "合名会社", "合資会社", "㈱", "（株）", "(株)", "K.K.", "KK")
#: Forms that the women's activity file's names are compared without (fixed values).
WOMEN_FORMS = ("株式会社", "(株)", "（株）", "有限会社", "合同会社", "ホールディングス", "holdings", "inc.", "inc", "co.,ltd.", "co.ltd.", "co ltd", "ltd.", "ltd")


def news_name_key(text: Column) -> Column:
    """Name in compatibility form and lower case, without forms of companies; Latin letters, digits, kana and kanji only."""
    plain = F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), NEWS_FORMS, "")
    return F.regexp_replace(plain, "[^0-9a-z\\u3040-\\u30ff\\u3400-\\u9fff]+", "")


def enrichment_name_key(text: Column) -> Column:
    """Name in compatibility form and capitals, without white space and marks, then without forms of companies."""
    out = F.regexp_replace(F.upper(nfkc(F.coalesce(text, F.lit("")))), r"[\s　]+", "")
    out = F.regexp_replace(out, r"[()（）・,，.．/／\\\-ー－_＿]", "")
    for form in ENRICHMENT_FORMS:
        out = F.replace(out, F.lit(form), F.lit(""))
    return out


def women_name_key(text: Column) -> Column:
    """Name in compatibility form and lower case, without forms of companies, then without white space and marks."""
    out = F.lower(nfkc(F.coalesce(text, F.lit(""))))
    for form in WOMEN_FORMS:
        out = F.replace(out, F.lit(form), F.lit(""))
    return F.regexp_replace(out, r"[\s　・･,，.．\-ー―_/／\\()（）\[\]【】]", "")


def security_code(text: Column) -> Column:
    """Four digits; of five that end in zero the first four; else ''."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    return F.when(digits.rlike("^[0-9]{4}0$"), F.substring(digits, 1, 4)).when(digits.rlike("^[0-9]{4}$"), digits).otherwise("")
