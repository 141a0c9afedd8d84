"""Reading and writing of the curation's files: CSV tables, COCO JSON, label text, lists, images."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None, keep_strings: bool = False) -> DataFrame:
    """A CSV with header.  Blank cells are null, or with ``keep_strings`` empty text; missing required columns raise."""
    reader = spark.read.option("header", True)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    lost = [c for c in required or [] if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks columns {lost}")
    return df.na.fill("") if keep_strings else df


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO JSON files."""
    schema = (
        "images array<struct<id:long,file_name:string,width:int,height:int>>,"
        "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>,"
        "categories array<struct<id:long,name:string,supercategory:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return tuple(doc.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "annotations", "categories"))


def coco_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each annotation with its image's and category's facts; categories are a small, bounded list."""
    i = images.select(F.col("id").alias("image_id"), "file_name", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("class_name"), "supercategory")
    box = [F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")]
    return annotations.select("image_id", "category_id", F.col("id").alias("annotation_id"), *box, "area", "iscrowd").join(i, "image_id").join(c, "category_id", "left")


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label files with their file's stem and split."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("path", F.input_file_name())
    folder = F.lower(F.regexp_extract("path", r"/(train|val|valid|validation|test)/", 1))
    split = F.when(folder.isin("valid", "validation"), "val").when(folder != "", folder)
    return lines.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), split.alias("split"), F.col("value").alias("line_text"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def split_folders(spark: SparkSession, root: str, splits: list[str]) -> list[tuple[str, str, str]]:
    """(split, images, labels) of the requested splits that are there, each pair of folders once.

    A split lies in ``<split>/images`` and ``<split>/labels``, or in ``images/<split>`` and ``labels/<split>``; val and valid
    stand for each other.
    """
    out: list[tuple[str, str, str]] = []
    for split in splits:
        wanted = split.strip()
        names = [wanted] + [n for n in ("val", "valid") if wanted in ("val", "valid") and n != wanted]
        pairs = [(n, *p) for n in names for p in ((f"{root}/{n}/images", f"{root}/{n}/labels"), (f"{root}/images/{n}", f"{root}/labels/{n}"))]
        found = next((p for p in pairs if _exists(spark, p[1]) and _exists(spark, p[2])), None)
        if found and found not in out:
            out.append(found)
    return out


def resolved_classes(lines: DataFrame, names: dict[int, str], wanted: list[str] | None = None, class_id: str = "cls") -> DataFrame:
    """``class_name`` of label lines; null for numbers without a name or of classes that are not wanted.  The list is small."""
    from ..operators.packs import class_filter

    kept = set(class_filter(list(names.values()), wanted))
    table = [F.lit(x) for i, n in names.items() if n in kept for x in (i, n)]
    return lines.withColumn("class_name", F.element_at(F.create_map(*table), F.col(class_id)) if table else F.lit(None).cast("string"))


def label_path(image_path):
    """The label file of an image: folder ``images`` becomes ``labels``, the suffix ``.txt``."""
    return F.regexp_replace(F.regexp_replace(image_path, "/images/", "/labels/"), r"\.[A-Za-z]+$", ".txt")


def class_names(text: str) -> dict[int, str]:
    """The ``names`` of a data.yaml, in list or mapping form."""
    out: dict[int, str] = {}
    inside = False
    for line in text.splitlines():
        if re.match(r"names\s*:", line):
            inside = True
            rest = line.partition(":")[2].strip()
            if rest.startswith("["):
                return {i: n.strip().strip("'\"") for i, n in enumerate(rest.strip("[]").split(",")) if n.strip()}
        elif inside and (m := re.match(r"\s*(?:(\d+)\s*:|-)\s*(.+)", line)):
            out[int(m[1]) if m[1] else len(out)] = m[2].strip().strip("'\"")
        elif inside and line.strip() and not line.startswith((" ", "-")):
            break
    return out


def listed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a text list: first word of each line, without blank lines and comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    parts = F.split("v", r"\s+")
    return lines.select(parts[0].alias("entry"), F.get(parts, F.lit(1)).alias("value"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; bytes are in BGR or BGRA order."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")


def listing(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,PNG,JPG,JPEG}") -> DataFrame:
    """Paths and sizes of files, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each value of the keys."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_columns(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV with header and exactly these columns in this order, replacing what is there; missing ones raise."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"the table lacks columns {lost}")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_names(df: DataFrame, folder: str, source: str, key: str, out: str = "export_path") -> DataFrame:
    """``out``: a path in each row's folder that no other row of the same file name has: the name itself for the least key, for others the key before it."""
    from ..operators.selection import ranked

    name = F.regexp_extract(source, r"([^/\\\\]*)$", 1)
    placed = ranked(df.withColumn("name_", name), [folder, "name_"], [key], "n_")
    safe = F.when(F.col("n_") == 1, F.col("name_")).otherwise(F.concat(F.col(key).cast("string"), F.lit("_"), "name_"))
    return placed.withColumn(out, F.concat(F.col(folder), F.lit("/"), safe)).drop("name_", "n_")


def dataset_yaml(root: str, names: dict[int, str], splits: tuple[str, ...] = ("train", "val", "test")) -> str:
    """The text of a training set's description."""
    lines = [f"path: {root}", *[f"{s}: images/{s}" for s in splits], f"nc: {len(names)}", "names:", *[f"  {i}: {n}" for i, n in sorted(names.items())]]
    return "\n".join(lines) + "\n"


def write_lists(df: DataFrame, path: str, image: str = "image_path", split: str = "split") -> None:
    """A folder of text files for each split with one image path a line, in natural order within files."""
    from ..functions.scalars import natural_key

    rows = df.select(F.col(split).alias("split"), F.col(image).alias("value"))
    rows.repartition("split").sortWithinPartitions("split", natural_key(F.col("value"))).write.mode("overwrite").partitionBy("split").text(path)
