"""Files of labels, predictions and thresholds; CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that receipt labels use for ours.
RENAMED = {"company": "vendor_name", "date": "date", "total": "total_amount"}
_ITEM = "struct<nm:string,cnt:string,unitprice:string,price:string>"


def write_small_files(files: DataFrame, path: str) -> None:
    """(name, body) as one text file each under path, written by the tasks that hold the rows."""

    def write(batches):
        import pandas as pd
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"], strict=True):
                fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(body.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("name", "body").mapInPandas(write, "n long").agg(F.sum("n")).first()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_receipt_labels(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """One small file a sample: a JSON object, else lines of key TAB value or key: value. Samples without an image are dropped.

    Keys are trimmed and lower-cased; empty values are null; fields is a map.
    """
    text = spark.read.text(labels, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("sample"), F.col("value").alias("text"))
    image = spark.read.format("binaryFile").load(images).select(_stem(F.col("path")).alias("sample"), F.col("path").alias("image")).distinct()
    json = F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"})
    line = lambda x: F.when(F.instr(x, "\t") > 0, F.split(x, "\t", 2)).otherwise(F.split(x, ":", 2))
    pairs = F.filter(F.transform(F.split("text", r"\r?\n"), line), lambda p: F.size(p) == 2)
    lines = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1))))))
    is_json = F.try_parse_json("text").isNotNull() & F.trim("text").startswith("{")
    entries = F.map_entries(F.when(is_json, json).otherwise(lines))
    clean = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.nullif(F.trim(e["value"]), F.lit("")).alias("v")))
    names = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    fields = F.map_from_entries(F.transform(clean, lambda e: F.struct(F.coalesce(F.try_element_at(names, e["k"]), e["k"]), e["v"])))
    return text.join(image, "sample").select("sample", "image", fields.alias("fields"))


def parse_nested_truth(df: DataFrame, column: str = "ground_truth") -> DataFrame:
    """Nested ground truth (gt_parse: menu, sub_total, total) as six fields and items; menu may be an object or a list."""
    tail = "sub_total:struct<subtotal_price:string,tax_price:string>,total:struct<total_price:string>"
    many = F.from_json(column, f"struct<gt_parse:struct<menu:array<{_ITEM}>,{tail}>>")["gt_parse"]
    one = F.from_json(column, f"struct<gt_parse:struct<menu:{_ITEM},{tail}>>")["gt_parse"]
    is_list = F.get_json_object(column, "$.gt_parse.menu").startswith("[")
    menu = F.when(is_list, many["menu"]).when(one["menu"].isNotNull(), F.array(one["menu"])).otherwise(F.array().cast(f"array<{_ITEM}>"))
    items = F.transform(menu, lambda m: F.struct(m["nm"].alias("description"), m["cnt"].alias("quantity"), m["unitprice"].alias("unit_price"), m["price"].alias("total")))
    either = lambda *path: F.coalesce(*[_dig(x, path) for x in (many, one)])
    none = F.lit(None).cast("string")
    return df.withColumns({"invoice_number": none, "date": none, "vendor_name": none, "subtotal": either("sub_total", "subtotal_price"), "tax": either("sub_total", "tax_price"), "total_amount": either("total", "total_price"), "items": items})


def _dig(column, path):
    for p in path:
        column = column[p]
    return column


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (timestamp, file, fields, raw_text): the newest entry of each file; of equally new ones that with the largest text."""
    log = spark.read.schema("timestamp string, file string, fields map<string,string>, raw_text string").json(path)
    return log.groupBy("file").agg(F.max_by(F.struct("timestamp", "fields", "raw_text"), F.struct("timestamp", "raw_text", F.to_json("fields"))).alias("r")).select("file", "r.*")


VERSION = 1


def save_thresholds(thresholds: DataFrame, path: str, version: int = VERSION, default: float = 0.5) -> None:
    """(field_name, threshold, and samples if there are any counts) as JSON lines, each with the version, the default and the time of the fit; a null
    threshold means the default. Without a field nothing is kept, not the default either."""
    samples = F.col("samples").cast("long") if "samples" in thresholds.columns else F.lit(None).cast("long")
    head = [F.lit(version).alias("version"), F.lit(default).alias("default_threshold"), F.current_timestamp().alias("fitted_at")]
    thresholds.select(*head, "field_name", "threshold", samples.alias("samples")).write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the current version only (another version counts as none, so readers use their own default): the field, its threshold or else the stored default, and the samples it was fitted on."""
    saved = spark.read.schema("version int, default_threshold double, fitted_at timestamp, field_name string, threshold double, samples long").json(path).where(F.col("version") == VERSION)
    return saved.select("field_name", F.coalesce("threshold", "default_threshold").alias("threshold"), F.col("threshold").isNotNull().alias("fitted"), "samples", "default_threshold", "fitted_at")


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(field_name, threshold) of load_calibration's rows, a null threshold where none was fitted."""
    return load_calibration(spark, path).select("field_name", F.when(F.col("fitted"), F.col("threshold")).alias("threshold"))
