"""Readers and writers: flexible CSV, JSON lines, header aliases, HTML cells, localised export."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_header(name: str) -> str:
    """A header without spaces, brackets and case."""
    return "".join(ch for ch in name.lower() if ch.isalnum())


def resolve_columns(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str | None]:
    """For each logical column the first alias that a header matches, else null."""
    known = {normalise_header(c): c for c in reversed(columns)}
    return {name: next((known[k] for a in [name, *names] if (k := normalise_header(a)) in known), None) for name, names in aliases.items()}


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One projection to the logical columns; missing ones are empty strings."""
    found = resolve_columns(df.columns, aliases)
    return df.select(*[(F.col(f"`{c}`").cast("string") if c else F.lit("")).alias(name) for name, c in found.items()])


#: Encodings that Spark's reader takes; others are read as bytes and decoded.
_READ_BY_SPARK = ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32")


def _csv(spark: SparkSession, path: str, encoding: str, sep: str) -> DataFrame:
    """A CSV file in one encoding; what it can't hold becomes a replacement character."""
    read = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("escape", '"')
    if encoding.upper() in _READ_BY_SPARK:
        return read.option("encoding", encoding).csv(path)
    # Latin-1 gives each byte as a character. Quotes are doubled, not escaped: a double-byte character may end in a backslash's byte.
    raw = read.option("encoding", "ISO-8859-1").csv(path)
    decoded = F.arrow_udf(lambda x: pa.array([None if v is None else v.encode("latin-1").decode(encoding, "replace") for v in x.to_pylist()], pa.string()), T.StringType())
    names = [c.encode("latin-1", "replace").decode(encoding, "replace") for c in raw.columns]
    renamed = raw.toDF(*[f"_c{k}" for k in range(len(names))])
    return renamed.select(*[decoded(F.col(f"_c{k}")).alias(name) for k, name in enumerate(names)])


def _readable(df: DataFrame) -> bool:
    """Whether neither headers nor any row have replacement characters."""
    if any("\ufffd" in c for c in df.columns):
        return False
    names = [F.col(f"`{c}`") for c in df.columns]
    return not names or df.filter(F.concat_ws("", *names).contains("\ufffd")).limit(1).count() == 0


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8",), sep: str = ",") -> DataFrame:
    """All columns as text, in the first of the encodings in which every header and row can be read, else the last.

    With several encodings, files are read through once for each that is tried.
    A byte-order mark is taken off the first header.
    """
    for encoding in encodings:
        df = _csv(spark, path, encoding, sep)
        if encoding == encodings[-1] or _readable(df):
            break
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})


def write_csv_encoded(df: DataFrame, path: str, encoding: str) -> None:
    """A CSV file of text columns in an encoding that Spark's writer lacks; a character that it can't hold fails the write."""
    as_bytes = F.arrow_udf(lambda x: pa.array([None if v is None else v.encode(encoding).decode("latin-1") for v in x.to_pylist()], pa.string()), T.StringType())
    out = df.select(*[as_bytes(F.col(f"`{c}`").cast("string")).alias(c.encode(encoding).decode("latin-1")) for c in df.columns])
    out.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def split_values(column: str) -> F.Column:
    """Parts of a text between bars, semicolons or line breaks, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"[|;；\n]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def write_localised(df: DataFrame, path: str, headers: dict[str, str]) -> None:
    """CSV with user-facing headers; the committer makes the write atomic."""
    df.withColumnsRenamed(headers).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def html_cells(html: F.Column, tag: str = "li") -> F.Column:
    """Texts of all elements of a tag, inner tags removed."""
    cells = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))


def semi_join_any(df: DataFrame, keys: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that match on any of several keys, as a union of equi semi-joins instead of an OR."""
    out = None
    for left, right in pairs:
        found = df.join(keys.select(F.col(right).alias("_k")).dropna().distinct(), F.col(left) == F.col("_k"), "left_semi")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def read_table(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8",)) -> DataFrame:
    """A table by the suffix of its path: csv, tsv, jsonl or json, parquet. All columns of text files are text."""
    suffix = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("jsonl", "json"):
        return spark.read.option("primitivesAsString", True).json(path)
    if suffix in ("csv", "tsv", "txt"):
        return read_csv(spark, path, encodings, "," if suffix == "csv" else "\t")
    raise ValueError(f"no reader for {path}")


def reload_clean(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """An earlier clean table with exactly ``columns``; missing ones are empty, rows without a key are left out."""
    rows = read_table(spark, path)
    out = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    return rows.select(*out).filter(F.trim(key) != "")


def semi_join_csv(spark: SparkSession, path: str, keys: DataFrame, pairs: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """Rows of a CSV whose keys are known, without the columns that nobody asked for.

    The scan reads the key columns and ``columns`` only, and the keys are met
    before anything else is done with a row.
    """
    known = read_csv(spark, path)
    wanted = [c for c in dict.fromkeys([*[a for a, _ in pairs], *columns]) if c in known.columns]
    return semi_join_any(known.select(*wanted), keys, pairs).select(*[c for c in columns if c in wanted])


def feature_rules(df: DataFrame, priority: dict[str, int]) -> list[tuple[str, str, int]]:
    """(name, eligibility, priority) of each column: identifiers, dates and texts are no features.

    Numbers have priority 1, or that of the first suffix that their name ends with.
    """
    out = []
    for field in df.schema.fields:
        if field.name.endswith(("key", "_id")):
            kind = "identifier"
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = "date"
        else:
            kind = "feature" if isinstance(field.dataType, T.NumericType) else "text"
        out.append((field.name, kind, next((p for suffix, p in priority.items() if field.name.endswith(suffix)), 1) if kind == "feature" else 0))
    return out


def threshold_sets(text: str) -> list[tuple[str, float, float]]:
    """(name, small, large) of each ``name:small:large`` between semicolons; names differ and limits ascend."""
    out = []
    for part in filter(None, map(str.strip, text.split(";"))):
        name, small, large = (x.strip() for x in part.split(":"))
        if not name or float(small) >= float(large) or name in [x[0] for x in out]:
            raise ValueError(f"bad threshold set: {part}")
        out.append((name, float(small), float(large)))
    return out
