"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger
holds, per blob, which rule versions have scanned it and what they found; only
pairs of blob and rule version that it lacks are scanned, each blob once however
many paths hold it, and the findings are joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.session import materialize


@dataclass(frozen=True)
class Rule:
    """``hints``: lower-case strings of which a text with a match holds one."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    flags: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules. A match whose group is shorter than ``least`` is dropped, after matching.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key"), re.I | re.A),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)

#: The rules that the method adds.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("google", 1, r"\bAIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<kind:string,start:int,stop:int>>"
_HEX = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))


def find_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of every finding, in code points, ordered by start and then rule.

    Matches are leftmost and don't overlap within a kind. A text is only
    searched by the rules of which it holds a hint.
    """
    lower, found = text.lower(), []
    for place, rule in enumerate(rules):
        if rule.kind == "hex":
            if b"1" * 16 not in text.encode("utf-8", "replace").translate(_HEX):
                continue
        elif rule.hints and not any(h in lower for h in rule.hints):
            continue
        for m in re.finditer(rule.pattern, text, rule.flags):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), place, m.end()))
    return [(rules[place].kind, start, stop) for start, place, stop in sorted(found)]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                chosen = tuple(r for r in rules if r.key in set(wanted))
                out.append([{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(text.as_py(), chosen)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, kind)], ["blob", "rules", "spans"])

    return run


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of all paths, and what the scan adds to the ledger.

    ``versions`` has a row for each version of a path. ``ledger`` (blob STRING,
    rules ARRAY<STRING>, spans) holds earlier scans. Returns (findings, added):
    findings has path, blob, spans ordered by start and then by rule, one row
    per row of ``versions``; append ``added`` to the ledger for the next run. A
    null text is the empty text. Other columns are ignored.
    """
    named = versions.select(F.col(path_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    named = named.withColumn("blob", F.sha2("text", 256))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = named.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        unseen = blobs.withColumn("missing", wanted)
    else:
        seen = ledger.groupBy(F.col("blob").alias("seen_blob")).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = blobs.join(seen, F.col("blob") == F.col("seen_blob"), "left")
        unseen = unseen.withColumn("missing", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("missing") > 0)
    scanned = unseen.select("blob", "text", "missing").mapInArrow(_scan(rules), f"blob string, rules array<string>, spans {SPANS}")
    added = materialize(scanned, "ledger")
    known = added if ledger is None else added.unionByName(ledger.select("blob", "rules", F.col("spans").cast(SPANS).alias("spans")))
    versions_now = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]), wanted)
    valid = F.filter("spans", lambda s: F.coalesce(F.array_contains("rules", versions_now[s["kind"]]), F.lit(False)))
    current = known.filter(F.size(valid) > 0)
    order = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(k) for k in range(len(rules))]))
    entry = F.transform(F.array_distinct(F.flatten(F.collect_list(valid))), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    per_blob = current.groupBy(F.col("blob").alias("found_blob")).agg(F.array_sort(entry).alias("sorted"))
    tidy = F.transform("sorted", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    # Written first, so that the join below is plain and a blob that very many paths hold can be split.
    per_blob = materialize(per_blob.select("found_blob", tidy.alias("spans")), "findings")
    paths = named.select("path", "blob")
    findings = paths.join(per_blob, F.col("blob") == F.col("found_blob"), "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return findings, added


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced; overlapping findings are replaced as one."""
    step = f"""aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) ->
        if(s.start >= a.at,
            named_struct('at', s.stop, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), '{mark}')),
            named_struct('at', greatest(a.at, s.stop), 'out', a.out)),
        a -> concat(a.out, substring(text, a.at + 1)))"""
    return F.when(F.size(spans) > 0, F.expr(step)).otherwise(text)
