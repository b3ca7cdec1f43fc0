"""Reading and writing records: scans, imports, the log, validation, signatures and codecs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import media

FINGERPRINT = """schema int, source_path string, fingerprint struct<width: int, height: int, mime: string, byte_hash: string, phash64: string, dhash64: string,
  visual: struct<luma_mean: int, luma_std: int, rgb_mean: array<int>, grid_luma: array<int>, text_grid: array<int>>,
  local_anchors: array<struct<id: string, x: int, y: int, w: int, h: int, pos_x: int, pos_y: int, hash: string, hash2: string, luma_mean: int, luma_std: int, edge_density: int, kind: string, region: int, max_distance: int>>,
  local_hashes: array<struct<x: int, y: int, w: int, h: int, pos_x: int, pos_y: int, region: int, hash: bigint, hash2: bigint, luma_mean: int, luma_std: int, edge_density: int, scale_percent: int, rotation_degrees: int>>>"""
SCHEMA_VERSION = 7


def scan_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each *.json below folder, in the order of paths; a file that can't be read ends the load."""
    d = spark.read.schema(FINGERPRINT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "FAILFAST").json(folder)
    checked = F.when(F.col("schema") == SCHEMA_VERSION, F.col("schema")).otherwise(F.raise_error(F.lit("another schema version")).cast("int"))
    return d.withColumn("schema", checked).withColumn("path", F.input_file_name()).orderBy("path")


def scan_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "gif", "webp", "bmp")) -> DataFrame:
    """path, length and content of supported image files below folder, sorted by path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return d.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).select("path", "length", "content").orderBy("path")


def parse_import(d: DataFrame, raw: str, schema: str) -> DataFrame:
    """Records of texts that hold a JSON object, an array of them, or one in each line (told by the first sign)."""
    t = F.trim(F.col(raw))
    one, many, lines = F.array(F.from_json(t, schema)), F.from_json(t, f"array<struct<{schema}>>"), F.transform(F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    rows = F.when(t.startswith("["), many).when(F.size(F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x).startswith("{"))) > 1, lines).otherwise(one)
    return d.select(F.explode(rows).alias("r")).select("r.*")


def problems(d: DataFrame) -> DataFrame:
    """id and the first problem of fingerprint records that don't fit, in the order of the checks.

    Hashes are hexadecimal (32 digits for the content, 16 for the others), both sides at least 1, arrays of 3, 16 and 64
    bytes (the text grid may be empty), regions below 64, sizes of features positive, scales positive.
    """
    hexa = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-fA-F]{{{n}}}$"), F.lit(False))
    bytes_ = lambda c: F.exists(c, lambda x: x.isNull() | (x < 0) | (x > 255))
    checks = [("width", F.coalesce(F.col("width") < 1, F.lit(True))), ("height", F.coalesce(F.col("height") < 1, F.lit(True))), ("byte_hash", ~hexa("byte_hash", 32)), ("phash64", ~hexa("phash64", 16)), ("dhash64", ~hexa("dhash64", 16))]
    checks += [(c, (F.size(c) != n) | bytes_(c)) for c, n in (("rgb_mean", 3), ("grid_luma", 16))]
    checks += [("text_grid", ~F.size("text_grid").isin(0, 64) | bytes_("text_grid")), ("anchor_hash", F.exists("local_anchors", lambda a: ~F.coalesce(a["hash"].rlike("^[0-9a-fA-F]{16}$"), F.lit(False)))), ("anchor_region", F.exists("local_anchors", lambda a: a["region"] >= 64)), ("anchor_size", F.exists("local_anchors", lambda a: (a["w"] < 1) | (a["h"] < 1))), ("feature_region", F.exists("local_hashes", lambda a: a["region"] >= 64)), ("feature_scale", F.exists("local_hashes", lambda a: a["scale_percent"] < 1))]
    p = F.coalesce(*[F.when(bad, name) for name, bad in checks])
    return d.select("id", p.alias("problem")).filter("problem is not null")


def flatten_media(d: DataFrame, id_: str, urls: str, most: int) -> DataFrame:
    """A row for each url of each message: the first of equals, most a message, with its index and their number."""
    e = d.select(id_, F.posexplode(urls).alias("i", "url"))
    first = e.groupBy(id_, "url").agg(F.min("i").alias("i"))
    r = first.withColumn("idx", F.row_number().over(Window.partitionBy(id_).orderBy("i"))).filter(F.col("idx") <= most)
    return r.select(id_, "url", (F.col("idx") - 1).alias("idx"), F.count("*").over(Window.partitionBy(id_)).alias("total"))


MESSAGE = """attachments array<struct<url: string, content_type: string, size: bigint, width: int, height: int>>,
  embeds array<struct<image: struct<url: string, width: int, height: int>, thumbnail: struct<url: string, width: int, height: int>>>,
  snapshots array<struct<attachments: array<struct<url: string, content_type: string, size: bigint, width: int, height: int>>,
    embeds: array<struct<image: struct<url: string, width: int, height: int>, thumbnail: struct<url: string, width: int, height: int>>>>>"""


def media_of(d: DataFrame, id_: str, most: int, hosts: list[str], extensions: list[str], max_bytes: int) -> DataFrame:
    """A row for each image of each message (columns as in MESSAGE): attachments, then images and thumbnails of embeds, then
    the same of each snapshot; urls on exact hosts, of allowed extensions (or, for attachments, such a type), attachments
    within the size and either an image by type or with both dimensions. Equal urls count once, the first; most a
    message. url, kind, mime, size, width, height, idx (from 0) and total."""
    item = lambda u, kind, mime, size, w, h: F.struct(u.alias("url"), F.lit(kind).alias("kind"), mime.alias("mime"), size.alias("size"), w.alias("width"), h.alias("height"))
    none = F.lit(None)
    hint = lambda u: F.when(media.extension(u).isin(*media.IMAGE_TYPES), F.concat(F.lit("image/"), F.when(media.extension(u) == "jpg", "jpeg").otherwise(media.extension(u))))
    on_host = lambda u: F.coalesce(u.startswith("https://") & media.host(u).isin(*hosts), F.lit(False))

    def attached(a: Column) -> Column:
        return item(a["url"], "attachment", F.coalesce(a["content_type"], hint(a["url"])), a["size"], a["width"], a["height"])

    def embedded(e: Column) -> Column:
        one = lambda k: item(e[k]["url"], f"embed_{k}", hint(e[k]["url"]), none.cast("bigint"), e[k]["width"], e[k]["height"])
        return F.array(one("image"), one("thumbnail"))

    def both(a: Column, e: Column) -> Column:
        return F.concat(F.coalesce(F.transform(a, attached), F.array()), F.coalesce(F.flatten(F.transform(e, embedded)), F.array()))

    every = F.concat(both(F.col("attachments"), F.col("embeds")), F.coalesce(F.flatten(F.transform("snapshots", lambda s: both(s["attachments"], s["embeds"]))), F.array()))
    e = d.select(id_, F.posexplode(every).alias("i", "m")).select(id_, "i", "m.*").filter(F.col("url").isNotNull())
    known = media.extension_allowed(media.extension(F.col("url")), extensions)
    image = F.coalesce(F.col("mime").startswith("image/"), F.lit(False))
    as_attached = (F.coalesce(F.col("size"), F.lit(0)) <= max_bytes) & (known | image) & (image | (F.col("width").isNotNull() & F.col("height").isNotNull()))
    ok = e.filter(on_host(F.col("url")) & F.when(F.col("kind") == "attachment", as_attached).otherwise(known))
    first = ok.groupBy(id_, "url").agg(F.min_by(F.struct("i", "kind", "mime", "size", "width", "height"), "i").alias("f")).select(id_, "url", "f.*")
    r = first.withColumn("idx", F.row_number().over(Window.partitionBy(id_).orderBy("i"))).filter(F.col("idx") <= most)
    return r.select(id_, "url", "kind", "mime", "size", "width", "height", (F.col("idx") - 1).alias("idx"), F.count("*").over(Window.partitionBy(id_)).alias("total"))


def replay(log: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """Latest row of each key, by order; keys whose latest row deletes are gone. Ties are settled by the whole order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("rn", F.row_number().over(w)).filter("rn = 1").filter(~deleted).drop("rn")


def recover(raw: DataFrame, parsed: DataFrame, key: str, rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """parsed and, for keys that aren't in it, what rebuild makes of their raw rows."""
    return parsed.unionByName(rebuild(raw.join(parsed.select(key), key, "left_anti")))


def capped_export(d: DataFrame, order: str, most_bytes: int) -> DataFrame:
    """order, line and refused: every row as a line of JSON where all of them, with line ends, are within the cap; else one
    row without a line, refused: an export is whole or it isn't made."""
    line = d.withColumn("line", F.to_json(F.struct(*d.columns)))
    total = line.agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("total"))
    lines = line.join(F.broadcast(total.filter(F.col("total") <= most_bytes)), how="cross").select(order, "line", F.lit(False).alias("refused"))
    return lines.unionByName(total.filter(F.col("total") > most_bytes).select(F.lit(None).cast(line.schema[order].dataType).alias(order), F.lit(None).cast("string").alias("line"), F.lit(True).alias("refused")))


def write_fingerprints(d: DataFrame, folder: str) -> None:
    d.write.mode("overwrite").json(folder)


def append_new(batch: DataFrame, folder: str, keys: list[str]) -> None:
    """Append the rows whose keys are new, in the batch and against what is stored. For foreachBatch."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        stored = spark.read.parquet(folder).select(*keys)
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        fresh = fresh.join(stored, keys, "left_anti")
    fresh.write.mode("append").parquet(folder)


def audit_row(fields: dict[str, Column]) -> Column:
    """key=value pairs on one line; blanks in values become "_"."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.regexp_replace(F.coalesce(v.cast("string"), F.lit("-")), r"\s", "_")) for k, v in fields.items()])


def action_intents(d: DataFrame, id_: str) -> DataFrame:
    """What a decision would have done, as rows in order; nothing is carried out here."""
    acts = F.when(F.col("decision") == "confirmed", F.array(*map(F.lit, ("delete", "timeout", "log")))).when(F.col("decision") == "suspicious", F.array(F.lit("log")))
    return d.select(id_, F.posexplode(acts).alias("i", "action")).select(id_, "action", (F.col("i") + 1).alias("seq"))


def hmac_sha256(message: Column, secret: str) -> Column:
    """HMAC-SHA256 in hexadecimal, composed of built-in hashes."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def encode(record: Column, prefix: str) -> Column:
    """Prefix and base64url (no padding) of the record's JSON."""
    b = F.base64(F.encode(F.to_json(record), "UTF-8"))
    return F.concat(F.lit(prefix), F.translate(F.regexp_replace(b, r"[=\s]", ""), "+/", "-_"))


def decode(code: Column, prefix: str, schema: str) -> Column:
    """The record, null where prefix or code don't fit. Fields that are missing are null."""
    body = F.translate(F.substring(code, len(prefix) + 1, 1 << 30), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(code.startswith(prefix), F.from_json(F.decode(F.unbase64(padded), "UTF-8"), schema))
