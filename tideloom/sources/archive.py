"""Archives of a community as files: JSON in and out, CSV, HTML and manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHOR = "struct<id:string,name:string>"
POST = f"id string, title string, content string, author {AUTHOR}, submolt struct<name:string>, upvotes long, downvotes long, comment_count long, created_at string"
COMMENT = f"id string, content string, author {AUTHOR}, post_id string, _post_id string, parent_id string, upvotes long, downvotes long, created_at string"


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path, which may be a pattern, names something in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def line_by_line(spark: SparkSession, path: str) -> bool:
    """True if each line is a JSON value of its own, as the first line of the first file tells; the files of a path have one form."""
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    try:
        return first is None or json.loads(first["value"]) is not None
    except ValueError:
        return False


def flat_posts(raw: DataFrame) -> DataFrame:
    """Nested author and community to columns; times that cannot be read are null, missing counts are 0."""
    return raw.select(
        "id", "title", "content", F.col("author.id").alias("author_id"), F.coalesce("author.name", F.lit("unknown")).alias("author_name"), F.col("submolt.name").alias("submolt"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("upvotes", "downvotes", "comment_count")), F.try_to_timestamp("created_at").cast("timestamp_ntz").alias("created_at"),
    ).filter("id is not null")


def flat_comments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "id", F.coalesce("post_id", "_post_id").alias("post_id"), "content", F.col("author.id").alias("author_id"), F.col("author.name").alias("author_name"), "parent_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("upvotes", "downvotes")), F.try_to_timestamp("created_at").cast("timestamp_ntz").alias("created_at"),
    ).filter("id is not null")


def read_posts(spark: SparkSession, candidates: list[str], pattern: str | None = None) -> DataFrame:
    """The first candidate that exists, a list of posts or an object with ``posts``; else one file per post."""
    for path in candidates:
        if exists(spark, path):
            raw = spark.read.schema(f"posts array<struct<{_fields(POST)}>>, {POST}").option("multiLine", not line_by_line(spark, path)).json(path)
            inner = raw.filter("posts is not null").select(F.explode("posts").alias("p")).select("p.*")
            return flat_posts(inner.unionByName(raw.filter("posts is null").drop("posts")))
    if pattern is None or not exists(spark, pattern):
        return flat_posts(spark.createDataFrame([], POST))
    return flat_posts(read_json(spark, pattern, POST))


def read_json(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All JSON files of a pattern; bad ones are skipped."""
    return spark.read.schema(schema).option("multiLine", not line_by_line(spark, pattern)).option("mode", "DROPMALFORMED").json(pattern)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """A list of comments, or a map from post to list whose key becomes the post."""
    text = spark.read.option("wholetext", not line_by_line(spark, path)).text(path)
    listed = text.filter(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<struct<{_fields(COMMENT)}>>")).alias("c")).select("c.*")
    mapped = text.filter(F.trim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,array<struct<{_fields(COMMENT)}>>>")).alias("key", "list")).select("key", F.explode("list").alias("c")).select("key", "c.*")
    mapped = mapped.withColumn("post_id", F.coalesce("post_id", "_post_id", "key")).drop("key")
    return flat_comments(listed.unionByName(mapped))


def _fields(ddl: str) -> str:
    """A column list as the inside of a struct type: a colon after each name."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def save_matrix(entries: DataFrame, folder: str, name: str) -> None:
    """A named sparse matrix (row_label, col_label, value) as a table of its own."""
    entries.select("row_label", "col_label", "value").write.mode("overwrite").parquet(f"{folder}/{name}")


def load_matrix(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def matrix_info(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Size of a stored matrix: entries, rows, columns and their sum."""
    return load_matrix(spark, folder, name).agg(F.count("*").alias("nnz"), F.countDistinct("row_label").alias("n_rows"), F.countDistinct("col_label").alias("n_cols"), F.sum("value").alias("total")).select(F.lit(name).alias("matrix"), "*")


# ---- sinks ---------------------------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows whose key the table at ``path`` lacks."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], cut: int = 1000) -> None:
    """Columns in a fixed order, content cut."""
    picked = df.select(*(F.substring(c, 1, cut).alias(c) if c == "content" else F.col(c) for c in columns))
    picked.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_html(pages: DataFrame, path: str) -> None:
    """One text file per task with a page on each line; line ends inside pages become blanks."""
    pages.select(F.regexp_replace("html", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of every file under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))


def combined(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Counts and one JSON line per post with its comments, instead of one document in one task."""
    of = comments.groupBy("post_id").agg(F.collect_list(F.struct("id", "author_name", "content")).alias("comments"))
    return posts.join(of, posts["id"] == of["post_id"], "left").select(posts["id"].alias("id"), F.to_json(F.struct("title", "author_name", "upvotes", "comments")).alias("document"))


def masked(url: str = "url"):
    """A URL column without its user name and password."""
    return F.regexp_replace(url, r"(?<=//)[^/@\s]+@", "***:***@")


def insight_cache(results: dict[str, DataFrame], as_of: str) -> DataFrame:
    """name, payload (JSON rows) and time of several results, a row for each result row."""
    out = None
    for name, df in results.items():
        part = df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("payload"), F.lit(as_of).alias("analyzed_at"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no results")
    return out

