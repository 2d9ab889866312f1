"""Correlation over windows that begin ever earlier, from states of each year that merge.

A year's state is its count, means, squared deviations and co-deviation, one
aggregate over all rows. The state of a window is the merge of its years', from
the last on, so each row is read once however many windows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of years merged from the newest on; each element is the state of a window.
_MERGED = """aggregate(_years, cast(array() as array<struct<start:int,n:double,mx:double,my:double,vx:double,vy:double,c:double>>), (done, s) ->
    if(size(done) = 0, array(s), concat(done, array(transform(array(element_at(done, -1)), a -> named_struct(
        'start', s.start, 'n', a.n + s.n, 'mx', a.mx + (s.mx - a.mx) * s.n / (a.n + s.n), 'my', a.my + (s.my - a.my) * s.n / (a.n + s.n),
        'vx', a.vx + s.vx + (s.mx - a.mx) * (s.mx - a.mx) * a.n * s.n / (a.n + s.n), 'vy', a.vy + s.vy + (s.my - a.my) * (s.my - a.my) * a.n * s.n / (a.n + s.n),
        'c', a.c + s.c + (s.mx - a.mx) * (s.my - a.my) * a.n * s.n / (a.n + s.n)))[0]))))"""


def expanding_correlations(long: DataFrame, by: Sequence[str], year: str, least: int = 10) -> DataFrame:
    """Per group and start year: n, pearson, previous, change and agrees, over all rows from that year on.

    ``long`` has x and y. A window counts with ``least`` complete rows and two
    values on each side; ``previous`` is the coefficient of the next shorter
    window that counts, ``agrees`` whether both have one sign. Years, which are
    few, are folded per group.
    """
    by = list(by)
    known = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(year).isNotNull())
    n = F.count(F.lit(1)).cast("double")
    state = F.struct(F.col("_start").alias("start"), "n", "mx", "my", "vx", "vy", "c")
    years = known.groupBy(*by, F.col(year).cast("int").alias("_start")).agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * n).alias("vx"), (F.var_pop("y") * n).alias("vy"), (F.covar_pop("x", "y") * n).alias("c")
    )
    folded = years.groupBy(*by).agg(F.sort_array(F.collect_list(state), asc=False).alias("_years")).select(*by, F.expr(_MERGED).alias("_windows"))
    flat = lambda w: (w["vx"] > 1e-12 * w["n"]) & (w["vy"] > 1e-12 * w["n"])
    counted = F.filter("_windows", lambda w: (w["n"] >= least) & flat(w))
    rows = folded.select(*by, F.posexplode(F.transform(counted, lambda w: F.struct(w["start"].alias("start_year"), w["n"].cast("long").alias("n"), (w["c"] / F.sqrt(w["vx"] * w["vy"])).alias("pearson")))).alias("_at", "_w"), counted.alias("_all"))
    before = F.col("_all")[F.col("_at") - 1]
    previous = F.when(F.col("_at") > 0, before["c"] / F.sqrt(before["vx"] * before["vy"]))
    out = rows.select(*by, "_w.*", previous.alias("previous"))
    return out.withColumns({"change": F.col("pearson") - F.col("previous"), "agrees": F.col("pearson") * F.col("previous") > 0})


def stability(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group over its windows: how many, whether all have one sign, the majority's share, and the range of the coefficients."""
    plus, minus = F.count_if(F.col("pearson") > 0), F.count_if(F.col("pearson") < 0)
    r, n = F.col("pearson"), F.count(F.lit(1))
    return windows.groupBy(*by).agg(
        n.alias("windows"), ((plus == n) | (minus == n)).alias("one_sign"), (F.greatest(plus, minus) / n).alias("majority"), F.percentile(r, 0.5).alias("median"),
        F.min(r).alias("least"), F.max(r).alias("most"), F.min(F.abs(r)).alias("least_abs"), F.percentile(F.abs(r), 0.5).alias("median_abs"),
    )
