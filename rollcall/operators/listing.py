"""The read side: search, pages, lookups, company list and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import fixed_values as fixed
from rollcall.functions.hashing import digest
from rollcall.functions.text import strip


def search(
    postings: DataFrame, companies: DataFrame, *, term: str | None = None,
    company: str | None = None, active: bool | None = None, title: str = "title",
    name: str = "name", closed: str = "is_closed", company_key: str = "company_id",
    id_column: str = "id",
) -> DataFrame:
    """Postings with their company as a struct, filtered; blank terms do not filter.

    The term is matched as plain text, so ``%`` and ``_`` stand for themselves. Filters on one
    side reach that side's scan; AQE broadcasts the companies when they are small.
    """
    rows = postings
    if active is not None:
        rows = rows.where(F.col(closed) == F.lit(not active))
    who = companies
    if company is not None and company.strip():
        who = who.where(F.lower(name) == company.strip().lower())
    right = who.select(F.struct("*").alias("company"))
    joined = rows.join(right, rows[company_key] == F.col(f"company.{id_column}"))
    if term is not None and term.strip():
        word = F.lit(term.strip().lower())
        joined = joined.where(
            F.contains(F.lower(title), word) | F.contains(F.lower(f"company.{name}"), word)
        )
    return joined


def check_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")


def page_of(
    rows: DataFrame, *, page: int = 1, size: int = 20, created: str = "created_at",
    id_column: str = "id",
) -> DataFrame:
    """Newest first, ties by id. Only offset + limit rows per partition are kept."""
    check_page(page, size)
    return rows.orderBy(F.desc(created), F.desc(id_column)).offset((page - 1) * size).limit(size)


def page_after(
    rows: DataFrame, last_created: Column, last_id: Column, *, size: int = 20,
    created: str = "created_at", id_column: str = "id",
) -> DataFrame:
    """The page that follows a known last row; its cost does not grow with the depth."""
    check_page(1, size)
    earlier = (F.col(created) < last_created) | (
        (F.col(created) == last_created) & (F.col(id_column) < last_id)
    )
    return rows.where(earlier).orderBy(F.desc(created), F.desc(id_column)).limit(size)


def page_info(rows: DataFrame, *, page: int = 1, size: int = 20) -> DataFrame:
    """Total and page numbers of a filtered listing, in one row."""
    check_page(page, size)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / F.lit(size))
    return total.select(
        "total",
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        pages.cast("bigint").alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        (F.lit(page > 1) & (pages > 0)).alias("has_previous"),
    )


def list_companies(companies: DataFrame, *, name: str = "name", id_column: str = "id"):
    return companies.orderBy(F.lower(name), name, id_column)


def by_base_hash(postings: DataFrame, value: str) -> DataFrame:
    if not value.strip():
        raise ValueError("base hash must not be empty")
    return postings.where(F.col("base_hash") == value.strip().lower())


def by_base_hashes(postings: DataFrame, wanted: DataFrame, *, column: str = "wanted"):
    """Look up a table of digests written in any case and with blanks."""
    keys = wanted.select(digest(column).alias("base_hash")).where("base_hash IS NOT NULL")
    return postings.join(keys.distinct(), "base_hash", "left_semi")


def system_stats(
    postings: DataFrame, companies: DataFrame, *, closed: str = "is_closed",
    job_type: str = "job_type",
) -> DataFrame:
    """Six counts in one row, zeros for empty tables; one pass over each table."""
    n_companies = companies.agg(F.count(F.lit(1)).alias("n")).scalar()
    flags = {
        "total_jobs": F.lit(True),
        "active_jobs": ~F.col(closed),
        "closed_jobs": F.col(closed),
        **{f"{t}_jobs": F.col(job_type) == t for t in fixed.JOB_TYPES},
    }
    counts = postings.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return counts.select(n_companies.alias("total_companies"), *flags)


def status_history(logs: DataFrame, job_ids: Sequence[int] | None = None) -> DataFrame:
    rows = logs if job_ids is None else logs.where(F.col("job_id").isin(*job_ids))
    return rows.orderBy("job_id", "changed_at", "id")


def named(companies: DataFrame, name: str) -> DataFrame:
    return companies.where(strip("name") == name.strip())
