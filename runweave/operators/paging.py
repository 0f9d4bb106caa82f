"""Pages of a table in the order of a key, found by counts of ranges of the key: no row gets a global number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a page without a number, and at most. Fixed values.
PAGE_ROWS, MOST_PAGE_ROWS = 250, 1_000
#: Ranges that a table is counted by at once, keys that are drawn to cut it, and rows of a range that is sorted.
RANGES, DRAWN, SORTED = 64, 1_024, 100_000


@dataclass
class Page:
    """rows: of the page, in order of the key when collected; the rest as a reader shows it. mode: page, family or full."""

    rows: DataFrame
    mode: str
    page: int
    page_size: int
    total: int
    total_pages: int
    has_previous: bool
    has_next: bool


def page_of(df: DataFrame, key: str, page: int | None = None, size: int | None = None) -> Page:
    """A page of the rows with a key (null keys are left out), numbered from 1; numbers and sizes beyond what there is are the nearest that are, those under 1 the default."""
    size = min(size if size and size > 0 else PAGE_ROWS, MOST_PAGE_ROWS)
    keyed = df.where(F.col(key).isNotNull())
    total = keyed.count()
    pages = max(1, -(-total // size))
    page = min(page if page and page > 0 else 1, pages)
    own, skip = _range_with(keyed, key, (page - 1) * size, total)
    rows = own.orderBy(key, *(c for c in sorted(df.columns) if c != key and _ordered(df, c))).offset(skip).limit(size)
    return Page(rows, "page", page, size, total, pages, page > 1, page < pages)


def _ordered(df: DataFrame, column: str) -> bool:
    return not dict(df.dtypes)[column].startswith(("map", "variant"))


def _range_with(df: DataFrame, key: str, place: int, rows: int) -> tuple[DataFrame, int]:
    """The rows of a range of keys that a place (from 0) falls in, with what follows it, and the rows of the range before the place.

    Bounds are keys drawn by a hash, so every round cuts the range to about a sixty-fourth; one key is never cut.
    """
    while rows > SORTED:
        drawn = sorted(r[0] for r in df.select(key).orderBy(F.xxhash64(key), key).limit(DRAWN).collect())
        bounds = sorted({drawn[k * len(drawn) // RANGES] for k in range(1, RANGES)} - {drawn[0]})
        if not bounds:
            break
        part = sum((F.when(F.col(key) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
        counts = dict(df.groupBy(part.alias("part")).count().collect())  # RANGES rows
        part_of, before = 0, 0
        while before + counts.get(part_of, 0) <= place and part_of < len(bounds):
            before += counts.get(part_of, 0)
            part_of += 1
        # the page may run on into the next ranges, so only what lies before is left out, and what lies a page behind
        last, ahead = part_of, before + counts.get(part_of, 0)
        while last < len(bounds) and ahead < place + MOST_PAGE_ROWS:
            last += 1
            ahead += counts.get(last, 0)
        kept: Column = F.lit(True)
        kept = kept & (F.col(key) >= F.lit(bounds[part_of - 1])) if part_of else kept
        kept = kept & (F.col(key) < F.lit(bounds[last])) if last < len(bounds) else kept
        if ahead - before >= rows:
            break
        df, place, rows = df.where(kept), place - before, ahead - before
    return df, place


def whole(df: DataFrame) -> Page:
    """All rows as one page."""
    total = df.count()
    return Page(df, "full", 1, max(total, 1), total, 1, False, False)


def jump_to(baselines: DataFrame, edges: DataFrame, family: str | None = None, run: str | None = None) -> Page:
    """The page of one family: named by its id, or by any of its runs (the baseline, a child, or a child's run without change).

    baselines: family_id, run_id; edges: kind (child or time0), source, target. An unknown name gives an empty page.
    """
    total = baselines.count()
    if family:
        rows = baselines.where(F.col("family_id") == family)
    else:
        to_child = edges.where("kind = 'child'").select("source", "target")
        children = to_child.where(F.col("target") == run).select(F.col("source").alias("run_id"))
        of_zero = edges.where(F.col("kind") == "time0").where(F.col("target") == run).select(F.col("source").alias("target"))
        roots = children.unionByName(to_child.join(of_zero, "target", "left_semi").select(F.col("source").alias("run_id")))
        sources = of_zero.select(F.col("target").alias("run_id"))
        rows = baselines.where(F.col("run_id") == run).unionByName(baselines.join(roots.unionByName(sources), "run_id", "left_semi")).distinct()
    n = rows.count()
    return Page(rows, "family", 1, min(n, 1), total, max(1, total), False, False)
