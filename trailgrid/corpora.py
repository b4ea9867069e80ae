"""Path corpora derived from the driver's tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages on drive C."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("C:/"), F.regexp_replace("url", "^https?://", "")).alias("path"), (F.col("page_id") % 7 == 3).alias("has_deleted_entries"))


PAGES = "(select 'C:/' || regexp_replace(url, '^https?://', '') as path, page_id % 7 = 3 as has_deleted_entries from pages)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of documents on drive D, deleted where they are labelled toxic."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "source", "lang").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    path = F.concat(F.lit("D:\\"), "source", F.lit("\\"), "lang", F.lit("\\doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.select(path.alias("path"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("has_deleted_entries"))


DOCS = r"""(select 'D:\' || source || '\' || lang || '\doc_' || d.doc_id || '.txt' as path, coalesce(toxic = 1, false) as has_deleted_entries
 from documents d left join labels l on d.doc_id = l.doc_id)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of parts on drive E, with extensions by size and some double ones."""
    ext = F.when(F.col("p_size") % 5 == 0, ".tar.gz").when(F.col("p_size") % 5 == 1, ".JAR").when(F.col("p_size") % 5 == 2, ".txt").when(F.col("p_size") % 5 == 3, "").otherwise(".git")
    path = F.concat(F.lit("E:\\"), "p_brand", F.lit("\\"), "p_type", F.lit("\\"), "p_name", ext)
    return table(spark, sf_dir, "part").select(path.alias("path"), (F.col("p_partkey") % 11 == 0).alias("has_deleted_entries"))


PARTS = r"""(select 'E:\' || p_brand || '\' || p_type || '\' || p_name || case p_size % 5 when 0 then '.tar.gz' when 1 then '.JAR'
 when 2 then '.txt' when 3 then '' else '.git' end as path, p_partkey % 11 = 0 as has_deleted_entries from part)"""

#: DuckDB: segments in lower case, and the last one.
SEGS = r"list_filter(string_split_regex(lower(path), '[/\\]'), lambda s: s <> '')"
TERM = f"list_extract({SEGS}, -1)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph of regions, nations, customers and orders under the root 5; every seventh order is deleted and
    every tenth customer also hangs below a second nation."""

    def rows(df, frn, parent, name, deleted=None) -> DataFrame:
        dead = F.lit(False) if deleted is None else deleted
        return df.select(frn.cast("long").alias("frn"), parent.cast("long").alias("parent_frn"), name.alias("name"), dead.alias("is_deleted"))

    r, n, c, o = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    ck = F.col("c_custkey")
    return (
        rows(r, F.col("r_regionkey") + 100, F.lit(5), F.col("r_name"))
        .unionByName(rows(n, F.col("n_nationkey") + 1000, F.col("n_regionkey") + 100, F.col("n_name")))
        .unionByName(rows(c, ck + 1_000_000, F.col("c_nationkey") + 1000, F.col("c_name")))
        .unionByName(rows(c.where(ck % 10 == 0), ck + 1_000_000, (F.col("c_nationkey") + 1) % 25 + 1000, F.col("c_name")))
        .unionByName(rows(o, F.col("o_orderkey") + 100_000_000, F.col("o_custkey") + 1_000_000, F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 7 == 0))
    )


LINKS = """(select cast(r_regionkey + 100 as bigint) as frn, cast(5 as bigint) as parent_frn, r_name as name, false as is_deleted from region
 union all select n_nationkey + 1000, n_regionkey + 100, n_name, false from nation
 union all select c_custkey + 1000000, c_nationkey + 1000, c_name, false from customer
 union all select c_custkey + 1000000, (c_nationkey + 1) % 25 + 1000, c_name, false from customer where c_custkey % 10 = 0
 union all select o_orderkey + 100000000, o_custkey + 1000000, 'order_' || o_orderkey, o_orderkey % 7 = 0 from orders)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: signup creates, purchase renames to, view renames from, error deletes, click overwrites data."""
    kind = F.col("event_type")
    reason = F.when(kind == "signup", 0x100).when(kind == "purchase", 0x2000).when(kind == "view", 0x1000).when(kind == "error", 0x200).otherwise(0x80000001)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("frn"), (F.col("user_id") % 10).alias("parent_frn"), F.col("event_id").alias("usn"), reason.cast("long").alias("reason"),
        F.when(F.col("user_id") % 3 == 0, 16).otherwise(32).cast("long").alias("file_attributes"), F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")).alias("name"),
    )


JOURNAL = """(select user_id as frn, user_id % 10 as parent_frn, event_id as usn, case event_type when 'signup' then 256 when 'purchase' then 8192
 when 'view' then 4096 when 'error' then 512 else 2147483649 end as reason, case when user_id % 3 = 0 then 16 else 32 end as file_attributes,
 'n' || (event_id % 7) as name from events)"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of orders in the file of their customer, some of them adjacent."""
    length = F.when(F.col("o_orderkey") % 3 == 0, 700).otherwise(1000)
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), (F.col("o_orderkey") * 1000).cast("long").alias("offset"), length.cast("long").alias("length"))


EXTENTS = "(select o_custkey % 50 as file, o_orderkey * 1000 as \"offset\", case when o_orderkey % 3 = 0 then 700 else 1000 end as length from orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lists of parts by brand: cluster counts and signed deltas, some of them holes."""
    p = table(spark, sf_dir, "part")
    delta = F.when(F.col("p_size") % 9 == 0, None).otherwise(F.col("p_size") * 10 - 200).cast("long")
    return p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("run_no"), (F.col("p_size") % 4).cast("long").alias("clusters"), delta.alias("delta"))


RUNS = "(select p_brand as file, p_partkey as run_no, cast(p_size % 4 as bigint) as clusters, case when p_size % 9 = 0 then null else cast(p_size as bigint) * 10 - 200 end as delta from part)"


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of the documents' paths with flipped flags, and new paths."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    path = F.concat(F.lit("D:\\"), "source", F.lit("\\"), "lang", F.lit("\\doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 6 == 0, ".new").otherwise(".txt"))
    return rows.where(F.col("doc_id") % 3 == 0).select(path.alias("path"), (~F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("has_deleted_entries"))


OVERLAY = r"""(select 'D:\' || source || '\' || lang || '\doc_' || d.doc_id || case when d.doc_id % 6 = 0 then '.new' else '.txt' end as path,
 not coalesce(toxic = 1, false) as has_deleted_entries from documents d left join labels l on d.doc_id = l.doc_id where d.doc_id % 3 = 0)"""
