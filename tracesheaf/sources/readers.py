"""Sources: image tables, metadata, result JSON, plate maps, settings, grouped CSV."""

from __future__ import annotations

import csv
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.schemas import MASKS, ROI_JSON

AXES = ["dataset", "p", "t", "c", "z", "y", "x"]


def isel(pixels: DataFrame, indexers: dict[str, int] | None = None, **more: int) -> DataFrame:
    """Pixels at the given axis indexes. Unknown axes are an error; without any index, so is a table of several positions."""
    want = {**(indexers or {}), **more}
    unknown = [a for a in want if a not in AXES or a not in pixels.columns]
    if unknown:
        raise ValueError(f"unknown axes {unknown}")
    if not want and len(pixels.select("p").distinct().limit(2).collect()) > 1:
        raise ValueError("several positions: give an index")
    for axis, at in want.items():
        pixels = pixels.where(F.col(axis) == at)
    return pixels.drop(*[a for a in want if a != "dataset"])


def metadata_at(frame_meta: DataFrame, indexers: dict[str, int]) -> DataFrame:
    """Frames whose index map holds every given pair."""
    for axis, at in indexers.items():
        frame_meta = frame_meta.where(F.element_at("index", axis) == at)
    return frame_meta


def event_index(meta: DataFrame) -> Column:
    """The index map of raw metadata, under its present key or the legacy one."""
    names = set(meta.columns)
    found = [F.col(f"{k}.index") for k in ("mda_event", "Event") if k in names]
    return F.coalesce(*found)


def read_frame_meta(spark: SparkSession, path: str) -> DataFrame:
    """S3: (key, index, raw) of all frames in metadata JSON files ``{"p0": [frame, ...], ...}``; other keys are left out."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "frames")).where(F.rlike("key", F.lit(r"^p\d+$")))
    each = parts.select("key", F.posexplode(F.from_json("frames", "array<string>")).alias("t", "raw"))
    index = F.coalesce(F.get_json_object("raw", "$.mda_event.index"), F.get_json_object("raw", "$.Event.index"))
    return each.select("key", "t", F.from_json(index, "map<string,int>").alias("index"), "raw")


def stage_positions(sequence: DataFrame, column: str = "sequence") -> DataFrame:
    """(p, name, x, y, z) of the stage positions in an acquisition sequence's JSON."""
    parsed = F.from_json(column, "stage_positions array<struct<name:string,x:double,y:double,z:double>>")
    return sequence.select(F.posexplode(parsed["stage_positions"]).alias("p", "s")).select("p", "s.*")


def is_result_file(name: Column) -> Column:
    """``<well>_<fov>[_p<pos>].json`` and nothing else: no plate maps, plate plans, settings or hidden files."""
    stem = F.regexp_replace(name, r"\.json$", "")
    parts = F.split(stem, "_")
    reserved = F.rlike(name, F.lit(r"plate_map|^plate_plan\.json$|^settings\.json$|^\."))
    three = (F.size(parts) == 3) & F.rlike(F.get(parts, F.lit(1)), F.lit(r"^\d+$")) & F.rlike(F.get(parts, F.lit(2)), F.lit(r"^.\d+$"))
    return F.endswith(name, F.lit(".json")) & ~reserved & F.rlike(parts[0], F.lit("^[a-zA-Z0-9]+$")) & ((F.size(parts) == 2) | three)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, globals, corrupt) of a folder of one JSON file for each field, or of what ``sinks.write_results`` wrote.

    Digit keys are regions, other keys globals; fields that the schema does not name are dropped, missing ones null; masks become structs.
    Files of ``write_results`` are read a region a line, so they may be of any length; others are read whole. Files, or regions of the former,
    that do not parse go to ``corrupt`` and do not stop the others.
    """
    base = spark.read.option("recursiveFileLookup", "true")
    file = F.col("_metadata.file_path")
    whole = base.text(path, wholetext=True, pathGlobFilter="*.json").select(F.url_decode(F.element_at(F.split(file, "/"), -1)).alias("file"), "value").where(is_result_file(F.col("file")))
    whole = whole.withColumn("fov", F.regexp_replace("file", r"\.json$", "")).withColumn("m", F.from_json("value", "map<string,string>"))
    own = F.url_decode(F.url_decode(F.regexp_extract(file, r"/fov=([^/]+)/part-[^/]*\.txt$", 1)))  # a folder's name is encoded, and its path once more
    lines = base.text(path, pathGlobFilter="part-*.txt").select(own.alias("fov"), "value").where("fov <> '' and value like '%\":%'")
    key = F.regexp_extract("value", r'^,?"([^"]*)":', 1)
    region = lines.select("fov", key.alias("key"), F.expr("substring(value, instr(value, '\":') + 2)").alias("json"))
    pairs = whole.select("fov", F.explode("m").alias("key", "json")).unionByName(region)
    digits = F.rlike("key", F.lit("^[0-9]+$"))
    parsed = pairs.where(digits).select("fov", F.col("key").cast("int").alias("roi"), F.from_json("json", ROI_JSON, {"mode": "PERMISSIVE"}).alias("r"))
    records = parsed.select("fov", "roi", "r.*").withColumns({c: parse_mask(c) for c in MASKS})
    broken = region.where(F.from_json("json", "map<string,string>").isNull()).select("fov", F.concat("fov", F.lit(".json")).alias("file")).distinct()
    corrupt = whole.where("m is null and trim(value) <> ''").select("fov", "file").unionByName(broken)
    return records, pairs.where(~digits).select("fov", "key", "json"), corrupt


def parse_mask(column: str) -> Column:
    """[[ys], [xs]], [h, w] read as text parts, into a struct (ys, xs, h, w)."""
    yx, hw = F.from_json(F.col(column)[0], "array<array<int>>"), F.from_json(F.col(column)[1], "array<int>")
    return F.when(F.col(column).isNotNull(), F.struct(yx[0].alias("ys"), yx[1].alias("xs"), hw[0].alias("h"), hw[1].alias("w")))


def parse_plate_map(text: DataFrame, column: str = "value") -> DataFrame:
    """(well, row, col, condition, color) from plate-map JSON in any of three layouts."""
    rows = text.select(F.explode(F.coalesce(F.from_json(column, "array<array<string>>"), F.array())).alias("r"))
    flat = F.size("r") == 5
    rc, cc = F.from_json(F.get("r", F.lit(1)), "array<int>"), F.from_json(F.get("r", F.lit(2)), "array<string>")
    return rows.where(F.size("r") >= 3).select(
        F.col("r")[0].alias("well"),
        F.when(flat, F.get("r", F.lit(1)).try_cast("int")).otherwise(rc[0]).alias("row"), F.when(flat, F.get("r", F.lit(2)).try_cast("int")).otherwise(rc[1]).alias("col"),
        F.when(flat, F.get("r", F.lit(3))).otherwise(cc[0]).alias("condition"), F.when(flat, F.get("r", F.lit(4))).otherwise(cc[1]).alias("color"),
    )


def parse_plate_records(text: DataFrame, column: str = "value") -> DataFrame:
    """The legacy layout of records ``{"name", "row", "column", "condition": [name, color]}``."""
    schema = "array<struct<name:string,row:int,column:int,condition:array<string>>>"
    r = text.select(F.explode(F.from_json(column, schema)).alias("r"))
    return r.select(F.col("r.name").alias("well"), F.col("r.row").alias("row"), F.col("r.column").alias("col"), F.col("r.condition")[0].alias("condition"), F.col("r.condition")[1].alias("color"))


def read_all_settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, settings) of every settings JSON under ``path``, one column for each setting; what a file lacks, or holds as null, has its default.

    Keys may be written with spaces for underscores. A file that does not parse has the defaults throughout.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = text.withColumn("m", F.transform_keys(F.from_json("value", "map<string,string>"), lambda k, _: F.replace(k, F.lit(" "), F.lit("_"))))
    kinds = {int: "int", float: "double", str: "string"}
    given = lambda f: F.try_element_at("m", F.lit(f.name)).try_cast(kinds[type(f.default)])
    return found.select("path", *[F.coalesce(given(f), F.lit(f.default)).alias(f.name) for f in fields(Settings)])


def read_settings(spark: SparkSession, path: str) -> Settings:
    """The settings of one file; without a file the defaults."""
    row = read_all_settings(spark, path).drop("path").first()
    return Settings(**row.asDict()) if row else Settings()


def dataset_of(path: Column) -> Column:
    """The dataset folder (``*.ome.zarr`` or ``*.tensorstore.zarr``) in a file's path."""
    return F.regexp_extract(path, r"([^/]+\.(?:ome|tensorstore)\.zarr)", 1)


def read_datasets(spark: SparkSession, path: str, files: str = "*.parquet") -> DataFrame:
    """The Parquet pixel tables under every dataset folder below ``path``, each row with its dataset; other files are left out."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).parquet(path)
    return df.withColumn("dataset", dataset_of(F.input_file_name())).where("dataset <> ''")


def csv_line(line: Column) -> Column:
    """``struct<key, cells>`` of a CSV line: the first cell, in quotes or not, and the others, none of which is quoted; blanks are null."""
    quoted = F.startswith(line, F.lit('"'))
    raw = F.when(quoted, F.regexp_extract(line, r'^"(?:[^"]|"")*"', 0)).otherwise(F.substring_index(line, ",", 1))
    key = F.when(quoted, F.replace(F.substring(raw, F.lit(2), F.char_length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
    rest = F.substring(line, F.char_length(raw) + 2, F.char_length(line))
    cells = F.transform(F.split(rest, ",", -1), lambda v: F.nullif(F.trim(v), F.lit("")))
    none = F.char_length(line) == F.char_length(raw)
    return F.struct(key.alias("key"), F.when(none, F.array().cast("array<string>")).otherwise(cells).alias("cells"))


def read_trace_csv(spark: SparkSession, path: str) -> DataFrame:
    """(fov, roi, trace) of wide trace CSV: a key cell ``<fov>_<roi>`` and a cell for each frame, blanks at the end of short rows.

    Lines are split into arrays, so a table may have any number of frames. Headers, whose second cell is ``t0``, are left out file by file;
    a blank cell between others is null.
    """
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r'^("[^"]*"|[^,]*),t0(,|$)')) & F.contains("value", F.lit("_")))
    line = lines.select(F.rtrim("value", F.lit(",")).alias("value")).select(csv_line(F.col("value")).alias("l"))
    fov, roi = F.regexp_extract("l.key", r"^(.*)_([^_]*)$", 1), F.regexp_extract("l.key", r"^(.*)_([^_]*)$", 2).cast("int")
    return line.select(fov.alias("fov"), roi.alias("roi"), F.col("l.cells").cast("array<double>").alias("trace"))


def read_grouped_csv(spark: SparkSession, path: str, parameter: str, suffixes: tuple[str, ...] = ("_Mean", "_SEM", "_N")) -> DataFrame:
    """Rows (fov, condition, mean, sem, n) of the grouped CSV of a parameter, one for each condition's cells that are not blank.

    ``path``: a folder that holds a file found by its suffix, or the folder of that name that ``sinks.export_grouped`` wrote. Lines are split into
    arrays and each file's names come from its own first line, so conditions cost no columns.
    """
    found = spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    mine = F.rlike("path", F.lit(rf"(_{parameter}\.csv|/{parameter}/[^/]*\.csv)$"))
    files = [r.path for r in found.where(mine).select("path").collect()]  # the files of one table
    if not files:
        raise FileNotFoundError(f"no table of {parameter} under {path}")
    first = spark.read.text(files[0]).head()[0]
    header = next(csv.reader([first]))
    at = {c: i for i, c in enumerate(header[1:])}
    conditions = [c[: -len(suffixes[0])] for c in header[1:] if c.endswith(suffixes[0])]
    places = F.lit([[at.get(f"{c}{s}", -1) for s in suffixes] for c in conditions]) if conditions else F.array().cast("array<array<int>>")
    line = spark.read.text(files).where(F.col("value") != F.lit(first)).select(csv_line(F.col("value")).alias("l"))
    cell = lambda p, k: F.get(F.col("l.cells"), p[k]).cast("double")
    each = F.zip_with(F.lit(conditions), places, lambda c, p: F.struct(c.alias("condition"), *[cell(p, k).alias(n) for k, n in enumerate(("mean", "sem", "n"))]))
    return line.select(F.col("l.key").alias("fov"), F.explode(each).alias("g")).select("fov", "g.*").where("mean is not null")


def with_legacy_name(fovs: DataFrame, records: DataFrame, prefer_short: bool = False) -> DataFrame:
    """Records of each field (pos_name, p), under ``<pos_name>_p<p>`` or, for older files, the bare name."""
    full, short = F.concat("pos_name", F.lit("_p"), F.col("p").cast("string")), F.col("pos_name")
    have = records.select("fov").distinct()
    f = fovs.withColumn("full", full).join(have.select(F.col("fov").alias("full"), F.lit(1).alias("__a")), "full", "left")
    f = f.join(have.select(F.col("fov").alias("pos_name"), F.lit(1).alias("__b")), "pos_name", "left")
    a, b = F.when(F.col("__a") == 1, F.col("full")), F.when(F.col("__b") == 1, short)
    return f.withColumn("fov", F.coalesce(b, a) if prefer_short else F.coalesce(a, b)).select("pos_name", "p", "fov").join(records, "fov")


def full_plate(genotype: DataFrame, treatment: DataFrame) -> DataFrame:
    """(well, condition_1, condition_2) of two plate maps, wells of either kept."""
    a = genotype.select("well", F.col("condition").alias("condition_1"))
    return a.join(treatment.select("well", F.col("condition").alias("condition_2")), "well", "full")


def with_plate(records: DataFrame, plate: DataFrame, fov: str = "fov") -> DataFrame:
    """Records with their well's conditions, null where the map lacks the well. A plate map is small; the planner broadcasts it by size."""
    return records.withColumn("well", F.substring_index(fov, "_", 1)).join(plate, "well", "left")
