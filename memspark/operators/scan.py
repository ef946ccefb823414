"""Scans and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import meta
from ..schema import L1


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; an empty or missing value is no filter."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def memories(df: DataFrame, workspace: str = "", layer: str = "", type: str = "") -> DataFrame:
    return where_all(df, workspace=workspace, layer=layer, type=type)


def one_of(column, values) -> Column:
    """Membership where None filters nothing and an empty list rejects everything."""
    if values is None:
        return F.lit(True)
    return F.col(column).isin(*values) if values else F.lit(False)


def by_id(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def by_hash(df: DataFrame, content_hash: str, workspace: str = "") -> DataFrame:
    return where_all(df, workspace=workspace).where(F.col("content_hash") == content_hash).orderBy("id").limit(1)


def contents_since(df: DataFrame, workspace: str, since: float) -> DataFrame:
    return memories(df, workspace, L1).where(F.col("created_at") >= since).select("content")


def with_vectors(df: DataFrame, dim: int) -> DataFrame:
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))


def live(df: DataFrame) -> DataFrame:
    return df.where(~meta.retired("metadata"))


def recent(df: DataFrame, workspace: str, limit: int = 0) -> DataFrame:
    """Episodes, newest first; no limit where it is 0 or less."""
    out = memories(df, workspace, L1).orderBy(F.desc("created_at"), "id")
    return out.limit(limit) if limit > 0 else out


def symbols_of_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("line_start", "memory_id")


def refs_of_symbol(refs: DataFrame, name: str, direction: str = "both") -> DataFrame:
    out, into = refs.where(F.col("src_symbol") == name), refs.where(F.col("dst_symbol") == name)
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction: {direction}")
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def meta_value(table: DataFrame, key: str) -> DataFrame:
    """One row: the value, or '' where the key is missing."""
    return table.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def users(table: DataFrame, username: str = "") -> DataFrame:
    return where_all(table, username=username).orderBy("username")


def tenant(df: DataFrame, workspace: str, admin: bool = False) -> DataFrame:
    """What a user may see."""
    return df if admin else df.where(F.col("workspace") == workspace)


def authorise(asked: str, own: str, admin: bool = False) -> str:
    """The workspace a request works in: a user's own, any for an admin; asking for another's is refused."""
    if admin:
        return asked or own
    if asked and asked != own:
        raise PermissionError(f"403: no access to workspace {asked}")
    return own


def listing(df: DataFrame, workspace: str = "", layer: str = "", type: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """Live memories, last updated first."""
    out = live(memories(df, workspace, layer, type)).orderBy(F.desc("updated_at"), F.desc("id"))
    return out.offset(max(0, offset)).limit(limit if limit > 0 else 20)


def page(df: DataFrame, workspace: str = "", layer: str = "", type: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows by id, one-row total before paging); at most 200 rows."""
    some = memories(df, workspace, layer, type)
    size = 50 if limit <= 0 else min(limit, 200)
    return some.orderBy("id").offset(max(0, offset)).limit(size), some.agg(F.count(F.lit(1)).alias("total"))
