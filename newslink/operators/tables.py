"""Table maintenance on DataFrames: insert-ignore, upsert, deletes, constraint checks, work lists."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslink.operators.dedup import keep_first


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def date_parameter(text: str | None, today: date) -> date:
    """A date up to today; `latest`, unreadable and future ones become two days ago."""
    latest = today - timedelta(days=2)
    try:
        found = date.fromisoformat(text or "")
    except ValueError:
        return latest
    return found if found <= today else latest


def source_query(art: DataFrame, media: list[str], start: str, end: str, lang: str, limit: int) -> DataFrame:
    """Articles of some media within dates in one language, the first `limit` in order of time."""
    day = F.to_date("pubtime")
    return art.where(F.col("medium_name").isin(media) & day.between(start, end) & (F.col("lang") == lang)).orderBy("pubtime", "id").limit(limit)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows to append: first of each key in the source, keys of the target left out."""
    return keep_first(source, keys, F.struct(*order)).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: str, values: list[str], latest: str | None = None) -> DataFrame:
    """Target rows with the source's values where it has the key, and the source's other rows.

    Of several source rows with one key, the one with the largest `latest` (default: the last of values) wins, nulls first,
    ties by the other values: as if they came one after the other. Source rows without a key are inserted as they are.
    """
    rows = F.struct(F.col(latest or values[-1]).alias("__latest"), *[F.col(v).alias(f"__{i}") for i, v in enumerate(values)])
    s = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(rows).alias("__row"))
    both = target.join(s, F.col(key) == F.col("__key"), "full_outer")
    has = F.col("__key").isNotNull()
    merged = both.select(F.coalesce("__key", key).alias(key), *[F.when(has, F.col(f"__row.__{i}")).otherwise(F.col(v)).alias(v) for i, v in enumerate(values)])
    return merged.unionByName(source.where(F.col(key).isNull()).select(key, *values))


def delete_where_key_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """check, key, n for each key that occurs more than once."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("check"), key.alias("key"), "n")


def orphans(df: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    lost = df.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
    return lost.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "key", "n")


def parse_worklist(lines: DataFrame, default_lang: str = "de") -> DataFrame:
    """Lines `title` or `title,lang` without blank and comment lines."""
    parts = F.split(F.trim("value"), ",")
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return kept.select(F.trim(parts[0]).alias("title"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.lit(default_lang)).alias("lang"))


def stale(worklist: DataFrame, articles: DataFrame, key: str, as_of: str, days: int = 7) -> DataFrame:
    """Work items whose article is missing or was updated `days` days before as_of, or earlier."""
    joined = worklist.join(articles.select(key, "last_updated"), key, "left")
    old = F.col("last_updated") <= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS")
    return joined.where(F.col("last_updated").isNull() | old)
