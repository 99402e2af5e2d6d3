"""Reading, aligning, checking and writing the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .shared import kept

# Columns and types of each table.
SCHEMAS: dict[str, str] = {
    "users": "id long, email string, display_name string, affiliation string, avatar_path string, email_public boolean, is_admin boolean, created_at timestamp_ntz, deleted_at timestamp_ntz",
    "auth_tokens": "token string, user_id long, created_at timestamp_ntz, last_used_at timestamp_ntz, revoked_at timestamp_ntz",
    "papers": "id long, doi string, title string, authors string, journal string, year int, created_at timestamp_ntz",
    "paper_editions": "id long, paper_id long, file_path string, sha256 string, uploaded_by long, created_at timestamp_ntz, references_status string, references_error string, references_at timestamp_ntz",
    "edition_references": "id long, edition_id long, key string, index int, raw string, title string, authors string, year int, journal string, doi string, arxiv_id string, page int, y double, resolved_status string, resolved_at timestamp_ntz, resolution string",
    "edition_citations": "id long, edition_id long, reference_id long, label string, page int, x double, y double, w double, h double, inferred boolean",
    "copies": "id long, paper_id long, user_id long, edition_id long, ignored_edition_id long, summary string, thought string, marketed boolean, is_author boolean, rating_expertise int, rating_reading int, rating_liking int, created_at timestamp_ntz",
    "comments": "id long, paper_id long, user_id long, content string, edition_id long, page int, anchor_type string, anchor string, name string, current_place boolean, created_at timestamp_ntz",
    "ink_strokes": "id long, edition_id long, user_id long, page int, points array<struct<x:double,y:double>>, color string, width double, opacity double, shape string, created_at timestamp_ntz",
    "rooms": "id long, paper_key string, paper_title string, created_by long, leader_id long, status string, scheduled_time string, platform string, style string, style_desc string, created_at timestamp_ntz",
    "room_participants": "id long, room_id long, user_id long, created_at timestamp_ntz",
    "room_messages": "id long, room_id long, user_id long, content string, created_at timestamp_ntz",
    "room_availabilities": "id long, room_id long, user_id long, availability string, created_at timestamp_ntz",
    "notifications": "id long, user_id long, room_id long, content string, read boolean, emailed boolean, created_at timestamp_ntz",
    "feedback": "id long, user_id long, content string, page string, contact string, resolved boolean, created_at timestamp_ntz",
    "settings": "key string, value string",
    "error_logs": "id long, method string, path string, message string, traceback string, created_at timestamp_ntz",
}
# Defaults of columns that older tables lack.
DEFAULTS: dict[str, dict] = {"users": {"email_public": False, "is_admin": False}, "copies": {"marketed": True, "is_author": False}, "comments": {"current_place": False}, "notifications": {"read": False, "emailed": False}, "feedback": {"resolved": False}, "edition_citations": {"inferred": False}}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def align_to_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """df with the schema's columns in its order: those it lacks take their default, those it has its type."""
    defaults = defaults or {}
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A declared table from Parquet, JSON or CSV files; files that lack a declared column have its default."""
    schema = schema_of(name)
    if fmt == "parquet":
        return align_to_schema(spark.read.parquet(path), schema, DEFAULTS.get(name))
    reader = spark.read.schema(schema)
    return align_to_schema(reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path), schema, DEFAULTS.get(name))


def read_with_rejects(spark: SparkSession, path: str, name: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a declared table in JSON lines or CSV files with a header.

    A line that is broken, or has a value of another type than its column, is no row: rejects has its text and the file it is
    in. Files that lack a declared column have its default. The files are read once for each of the two that is used.
    """
    schema = schema_of(name)
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("__broken", T.StringType())])).options(mode="PERMISSIVE", columnNameOfCorruptRecord="__broken")
    parsed = raw.option("header", True).csv(path) if fmt == "csv" else raw.json(path)
    held = kept(parsed.withColumn("__file", F.input_file_name()), "parsed")
    rejects = held.filter("__broken is not null").select(F.col("__broken").alias("line"), F.col("__file").alias("file"))
    return align_to_schema(held.filter("__broken is null").select(*schema.names), schema, DEFAULTS.get(name)), rejects


def store_files(files: DataFrame, store: str) -> DataFrame:
    """Keep binary files (path, content) under the digest of their bytes: (path, sha256, file_name, stored) of each file, stored
    where its bytes were new and this path, the least of equal ones, brought them.

    The store is a table by the first two digits of the digest. Digests that are there are found by a join that reads no
    content, and nothing is written for them; a second run over the same files writes nothing.
    """
    spark = files.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    schema = "sha256 string, file_name string, content binary, prefix string"
    held = (spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)).select("sha256")
    named = files.select("path", F.sha2("content", 256).alias("sha256"))
    new = named.join(held, "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("path"))
    out = kept(named.join(new.select("path", F.lit(True).alias("__new")), "path", "left").select("path", "sha256", F.concat("sha256", F.lit(".pdf")).alias("file_name"), F.coalesce("__new", F.lit(False)).alias("stored")), "files")
    if not out.filter("stored").isEmpty():
        bytes_ = files.join(out.filter("stored").select("path", "sha256", "file_name"), "path").select("sha256", "file_name", "content", F.substring("sha256", 1, 2).alias("prefix"))
        bytes_.write.mode("append").partitionBy("prefix").parquet(store)
    return out


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary files: path, modificationTime, length, content. Files without a byte are not listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def write_partition_replace(df: DataFrame, path: str, key: str = "edition_id") -> None:
    """Write df by key; keys in df are replaced whole, other keys' files stay."""
    df.repartition(key).write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_export(bundle: DataFrame, path: str) -> None:
    """One JSON document for each reader, in a folder of the reader's own."""
    bundle.repartition("user_id").write.partitionBy("user_id").mode("overwrite").json(path)


def scrub_snapshot(settings: DataFrame, site_url: str) -> DataFrame:
    """settings without rows like smtp_% (where _ is any character), and with site_url set."""
    own = settings.sparkSession.createDataFrame([("site_url", site_url)], "key string, value string")
    return settings.filter("key not like 'smtp_%' and key <> 'site_url'").select("key", "value").unionByName(own)


def _too_long(c: str, n: int) -> tuple[str, Column]:
    return f"{c} too long", F.length(c) > n


def rules_of(table: str) -> list[tuple[str, Column]]:
    """(name, violated) of each rule of a table."""
    if table == "copies":
        return [*((f"{c} out of range", ~F.col(c).between(1, 5)) for c in ("rating_expertise", "rating_reading", "rating_liking")), _too_long("thought", 200)]
    if table == "comments":
        placed = F.col("page").isNotNull()
        spot = F.from_json("anchor", "x double, y double")
        return [
            ("page and anchor go together", placed != F.col("anchor").isNotNull()),
            ("a plain note needs text", ~placed & (F.length(strip(F.coalesce("content", F.lit("")))) == 0)),
            _too_long("content", 4000),
            ("anchor out of range", ~(spot["x"].between(0, 1) & spot["y"].between(0, 1))),
            ("page out of range", F.col("page") < 1),
            *([_too_long("name", 120)]),
        ]
    if table == "ink_strokes":
        return [
            ("number of points", ~F.size("points").between(1, 4000)),
            ("point out of range", ~F.forall("points", lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))),
            ("color", ~F.col("color").rlike("^#[0-9a-fA-F]{6}$")),
            ("width", ~((F.col("width") > 0) & (F.col("width") <= 0.1))),
            ("opacity", ~((F.col("opacity") > 0) & (F.col("opacity") <= 1))),
            ("shape", ~F.col("shape").isin("flat", "round")),
        ]
    if table == "users":
        return [("email", ~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") | (F.length("email") > 254)), ("name", ~F.length("display_name").between(1, 80)), _too_long("affiliation", 120)]
    limits = {"rooms": [("scheduled_time", 200), ("platform", 200), ("style", 40), ("style_desc", 300)], "room_messages": [("content", 4000)], "room_availabilities": [("availability", 500)], "feedback": [("content", 4000), ("page", 300), ("contact", 254)]}
    return [_too_long(c, n) for c, n in limits[table]]


def validate(df: DataFrame, table: str) -> DataFrame:
    """df with violations, the names of the rules that each row breaks. A rule on a null value is kept."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules_of(table) if name.split(" too long")[0] in df.columns or " too long" not in name]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))
