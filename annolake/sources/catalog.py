"""The document tree, page lists and saved settings, from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METADATA = "visibleName string, parent string, lastModified string, type string, pinned boolean, deleted boolean"
KINDS = ("DocumentType", "CollectionType")


def metadata(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``meta`` and ``error``: the first required field that is missing or wrong, else null."""
    meta = F.from_json(text, METADATA)
    required = ("visibleName", "parent", "lastModified", "type", "pinned")
    error = F.coalesce(
        F.when(~F.trim(F.col(text)).startswith("{") | F.col(text).isNull() | F.get_json_object(text, "$").isNull(), F.lit("not an object")),
        *(F.when(meta[f].isNull(), F.lit(f)) for f in required), F.when(~meta["type"].isin(*KINDS), F.lit("type")),
    )
    return rows.withColumn("error", error).withColumn("meta", F.when(error.isNull(), meta))


def documents(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("type") == "DocumentType")


def is_source_backed(file_type: Column) -> Column:
    return file_type.isin("pdf", "epub")


def live_pages(content: DataFrame) -> DataFrame:
    """(doc_id, page_id, position, source_index, device_added) of (doc_id, file_type, c_pages array<struct<id, idx, deleted, redir>>, pages array<string>):
    deleted pages go, the rest are ordered by their fractional index, byte by byte; the old form is in array order."""
    backed = is_source_backed(F.col("file_type"))
    new = content.where(F.size("c_pages") > 0).select("doc_id", backed.alias("backed"), F.posexplode("c_pages").alias("n", "p")).where(F.coalesce(F.col("p.deleted"), F.lit(0)) == 0)
    order = W.partitionBy("doc_id").orderBy("p.idx", "n")
    new = new.select("doc_id", F.col("p.id").alias("page_id"), (F.row_number().over(order) - 1).alias("position"), F.col("p.redir").alias("redir"), "backed")
    new = new.withColumn("device_added", F.col("backed") & F.col("redir").isNull())
    old = content.where(F.coalesce(F.size("c_pages"), F.lit(0)) <= 0).select("doc_id", F.posexplode("pages").alias("position", "page_id"))
    left = new.select("doc_id", "page_id", "position", F.when(F.col("backed"), F.col("redir")).otherwise(F.col("position")).alias("source_index"), "device_added")
    return left.unionByName(old.select("doc_id", "page_id", "position", F.col("position").alias("source_index"), F.lit(False).alias("device_added")))


def page_files(files: DataFrame) -> DataFrame:
    """(doc_id, pages map, images map, epub): a document's files by kind; of two images with one base name the later one counts."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    is_page, is_image = F.col("path").endswith(".rm"), F.lower("path").rlike(r"\.(png|jpe?g)$")
    kinds = files.select("doc_id", "hash", "ord", name.alias("name"), F.when(is_page, "page").when(is_image, "image").when(F.lower("path").endswith(".epub"), "epub").alias("kind"))
    last = kinds.where(F.col("kind").isNotNull()).groupBy("doc_id", "kind", "name").agg(F.max_by("hash", "ord").alias("hash"))

    def of(kind: str, key: Column) -> Column:
        return F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("kind") == kind, F.struct(key, F.col("hash"))))))

    return last.groupBy("doc_id").agg(of("page", F.regexp_replace("name", r"\.rm$", "")).alias("pages"), of("image", F.col("name")).alias("images"), F.max(F.when(F.col("kind") == "epub", F.col("hash"))).alias("epub"))


SETTINGS = "attachmentsFolder string, attachmentFolder string, tagFolders map<string,string>, ocrBackend string, autoSyncHours int, backendSettings map<string,map<string,string>>"
#: Fixed defaults.
DEFAULTS = {"attachments_folder": "attachments", "ocr_backend": "off", "auto_sync_hours": 0}


def settings(saved: DataFrame, backends: tuple[str, ...], text: str = "saved") -> DataFrame:
    """Saved settings of any age as complete ones: each field by its name, its former name or its default; an unknown backend is off."""
    s = F.from_json(text, SETTINGS)
    backend = s["ocrBackend"]
    return saved.select(
        "*", F.coalesce(s["attachmentsFolder"], s["attachmentFolder"], F.lit(DEFAULTS["attachments_folder"])).alias("attachments_folder"),
        F.coalesce(s["tagFolders"], F.create_map().cast("map<string,string>")).alias("tag_folders"), F.when(backend.isin(*backends), backend).otherwise(DEFAULTS["ocr_backend"]).alias("ocr_backend"),
        F.coalesce(s["autoSyncHours"], F.lit(DEFAULTS["auto_sync_hours"])).alias("auto_sync_hours"), F.coalesce(s["backendSettings"], F.create_map().cast("map<string,map<string,string>>")).alias("backend_settings"),
    )
