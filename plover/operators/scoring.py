"""Scores of patents and papers by classifications and terms, in capped bands."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plover.functions.unicode import nfkc

_NOT_COMPACT = "[^0-9a-z぀-ヿ㐀-鿿]"
_CJK = re.compile("[぀-ヿ㐀-鿿]")


def word_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a lower-cased text holds: as whole Latin words, or anywhere if they have kana or kanji."""

    def held(term: str) -> Column:
        needle = term.strip().lower()
        return text.contains(needle) if _CJK.search(needle) else text.rlike("(?<![a-z0-9])" + re.escape(needle) + "(?![a-z0-9])")

    wanted = [t for t in terms if t.strip()]
    return F.array_compact(F.array(*[F.when(held(t), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")


def _band(n: Column, base: float, step: float, cap: float) -> Column:
    """Points of ``n`` hits: none without any, else the base and a step a hit, capped."""
    return F.when(n > 0, F.least(F.lit(float(cap)), F.lit(float(base)) + step * n)).otherwise(0.0)


@dataclass(frozen=True)
class Technology:
    """Prefixes of codes and terms that count, for the target itself and, with fewer points, around it."""

    cpc: tuple[str, ...] = ()
    ipc: tuple[str, ...] = ()
    broad_cpc: tuple[str, ...] = ()
    broad_ipc: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    broad_terms: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def _prefix_hits(codes: Column, prefixes: Sequence[str]) -> Column:
    upper = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.replace(F.upper(c), F.lit(" "), F.lit("")))
    wanted = sorted(set(prefixes))
    return F.array_compact(F.array(*[F.when(_starts(upper, p), F.lit(p)) for p in wanted])) if wanted else F.array().cast("array<string>")


def _starts(codes: Column, prefix: str) -> Column:
    return F.exists(codes, lambda c: c.startswith(prefix.upper()))


def compact_text(text: Column) -> Column:
    """Latin letters, digits, kana and kanji of the compatibility form, in lower case."""
    return F.regexp_replace(nfkc(F.lower(F.coalesce(text, F.lit("")))), _NOT_COMPACT, "")


def technology_score(cpc: Column, ipc: Column, text: Column, compact: Column, tags: Column, what: Technology) -> Column:
    """0 to 100: target codes 35 + 7 each to 55 and 8 + 4 to 20, broad ones 12 + 4 to 30, terms 6 to 30, broad terms 3 to 24, the company's tags 5 to 20, less 15 an excluded term to 50.

    A prefix is looked up among the codes of both kinds. Terms match in the
    lower-cased text or, without marks and spaces, in ``compact``, a column of
    `compact_text`. Nulls are empty.
    """
    both = F.concat(F.coalesce(cpc, F.array().cast("array<string>")), F.coalesce(ipc, F.array().cast("array<string>")))
    low = F.lower(F.coalesce(text, F.lit("")))

    def terms_hit(terms: Sequence[str]) -> Column:
        found = []
        for term in terms:
            plain = unicodedata.normalize("NFKC", term).strip().lower()
            short = re.sub(_NOT_COMPACT, "", plain)
            if plain:
                found.append(F.when(low.contains(plain) | (compact.contains(short) if short else F.lit(False)), F.lit(term)))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    own_tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    tag_hits = F.filter(own_tags, lambda t: (t != "") & (low.contains(t) | ((F.regexp_replace(t, _NOT_COMPACT, "") != "") & compact.contains(F.regexp_replace(t, _NOT_COMPACT, "")))))
    target_cpc, target_ipc, keywords = _prefix_hits(both, what.cpc), _prefix_hits(both, what.ipc), terms_hit(what.terms)
    broad = F.array_union(F.array_except(_prefix_hits(both, what.broad_cpc), target_cpc), F.array_except(_prefix_hits(both, what.broad_ipc), target_ipc))
    broad_keywords = F.array_except(terms_hit(what.broad_terms), keywords)
    excluded = F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in what.excluded])) if what.excluded else F.array().cast("array<string>")
    score = (
        _band(F.size(target_cpc), 35, 7, 55) + _band(F.size(target_ipc), 8, 4, 20) + _band(F.size(broad), 12, 4, 30) + _band(F.size(keywords), 0, 6, 30)
        + _band(F.size(broad_keywords), 0, 3, 24) + _band(F.size(tag_hits), 0, 5, 20) - _band(F.size(excluded), 0, 15, 50)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


@dataclass(frozen=True)
class Profile:
    """What a reader looks for; a paper must have a term of each required group."""

    id: str
    required_title: tuple[str, ...] = ()
    required_title_groups: tuple[tuple[str, ...], ...] = ()
    required_groups: tuple[tuple[str, ...], ...] = ()
    strong: tuple[str, ...] = ()
    related: tuple[str, ...] = ()
    industry: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def profile_score(title: Column, abstract: Column, categories: Column, profile: Profile, title_only: Column | None = None) -> Column:
    """0 to 100 for one profile, 0 if a required group has no term.

    ``title_only`` marks sources without abstracts, whose strong titles count 15 more.
    """
    t, a, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (title, abstract, categories))
    both = F.concat_ws(" ", t, a)
    groups = [(t, g) for g in ((profile.required_title,) if profile.required_title else ()) + profile.required_title_groups] + [(both, g) for g in profile.required_groups]
    met = F.lit(True)
    for where, group in groups:
        met = met & (F.size(word_hits(where, group)) > 0)
    n = F.size
    strong_t, strong_a, related_t, related_a = word_hits(t, profile.strong), word_hits(a, profile.strong), word_hits(t, profile.related), word_hits(a, profile.related)
    distinct = n(F.array_distinct(F.concat(strong_t, strong_a, related_t, related_a)))
    score = F.lit(15.0 if groups else 0.0) + F.when(n(word_hits(c, profile.categories)) > 0, 25.0).otherwise(0.0)
    score = score + _band(n(strong_t), 15, 5, 25) + _band(n(strong_a), 8, 3, 20) + _band(n(related_t), 5, 2, 10) + _band(n(related_a), 3, 1, 10)
    if title_only is not None:
        score = score + F.when(title_only & (a == "") & (n(strong_t) > 0), 15.0).otherwise(0.0)
    score = score + F.when(distinct >= 3, 10.0).otherwise(0.0) + _band(n(word_hits(both, profile.industry)), 4, 2, 10) + F.when(a != "", 5.0).otherwise(0.0) - _band(n(word_hits(both, profile.excluded)), 20, 5, 40)
    return F.when(met, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def best_profile(title: Column, abstract: Column, categories: Column, profiles: Sequence[Profile], title_only: Column | None = None) -> Column:
    """A struct of score and profile: the best, the first of equal ones."""
    scored = [F.struct(profile_score(title, abstract, categories, p, title_only).alias("score"), F.lit(-k).alias("turn"), F.lit(p.id).alias("profile")) for k, p in enumerate(profiles)]
    best = F.array_max(F.array(*scored))
    return F.struct(best["score"].alias("score"), best["profile"].alias("profile"))
