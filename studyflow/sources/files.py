"""Sources, sinks and ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import stored

#: Encodings in the order they are tried (fixed values).
ENCODINGS = ("utf-8", "gb18030", "utf-16")


def load(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A table with a fixed schema."""
    return spark.read.schema(schema).parquet(f"{root}/{name}.parquet")


def decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="ignore")


def decode_contents(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": pd.Series([decode(bytes(c)) if c is not None else None for c in pdf["content"]], dtype=object)})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def read_corpus(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of text files, whatever their encoding."""
    return decode_contents(spark.read.format("binaryFile").load(glob))


def read_bytes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content, file_type, month) of files of any kind, byte for byte; the month is that of their last change."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type"), F.date_format("modificationTime", "yyyyMM").alias("month"))


def ingest(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New files (id, content, file_type, month) known by the SHA-256 of their bytes: (id, sha256, stored_id, path, is_new).

    ``content`` is what :func:`read_bytes` gives; files that have a ``text`` instead are taken as its UTF-8.  A known hash gives the stored file; of equal ones in the batch the smallest id is stored.
    """
    rows = new.withColumn("sha256", F.sha2("content" if "content" in new.columns else F.encode("text", "UTF-8"), 256))
    first = rows.groupBy("sha256").agg(F.min("id").alias("first_id"), F.min_by(F.struct("month", "file_type"), "id").alias("f"))
    known = existing.groupBy("sha256").agg(F.min("id").alias("known_id"))
    named = first.join(known, "sha256", "left").select("sha256", F.coalesce("known_id", "first_id").alias("stored_id"), F.concat(F.lit("library/"), "f.month", F.lit("/"), "sha256", F.lit("."), "f.file_type").alias("path"), F.col("known_id").isNull().alias("fresh"), "first_id")
    out = rows.join(named, "sha256")
    return out.select("id", "sha256", "stored_id", "path", (F.col("fresh") & (F.col("id") == F.col("first_id"))).alias("is_new"))


def apply_overrides(files: DataFrame, defaults: dict[str, str], overrides: DataFrame) -> DataFrame:
    """Each file's metadata: an override that has the key wins, even with a null value, over the default.

    ``overrides`` is (id, meta), a map; a key that it lacks differs from one that it holds as null.
    """
    rows = files.join(overrides, "id", "left")
    pick = lambda k, v: F.when(F.coalesce(F.map_contains_key("meta", F.lit(k)), F.lit(False)), F.try_element_at("meta", F.lit(k))).otherwise(F.lit(v)).alias(k)
    return rows.select("id", *(pick(k, v) for k, v in defaults.items()))


def copy_columns(source: DataFrame, target: T.StructType) -> tuple[DataFrame, list[str]]:
    """The source's columns that the target has, with its types, and the names of those missing.

    JSON text is parsed where a column is nested.  What cannot be parsed or cast is null there and stays as it was in the
    map ``raw``, by column.
    """
    have = [f for f in target if f.name in source.columns]
    missing = [f.name for f in target if f.name not in source.columns]

    def cast(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        if nested and isinstance(source.schema[f.name].dataType, T.StringType):
            return F.from_json(F.when(F.get_json_object(f.name, "$").isNotNull(), F.col(f.name)), f.dataType)
        return F.col(f.name).try_cast(f.dataType)

    typed = source.select(*(F.col(f.name).alias(f"_{f.name}") for f in have), *(cast(f).alias(f.name) for f in have))
    failed = F.filter(F.array(*(F.struct(F.lit(f.name).alias("key"), F.col(f"_{f.name}").cast("string").alias("value")) for f in have)), lambda x: x["value"].isNotNull())
    lost = F.filter(failed, lambda x: F.coalesce(F.try_element_at(F.create_map(*(y for f in have for y in (F.lit(f.name), F.col(f.name).isNull()))), x["key"]), F.lit(False)))
    return typed.select(*(f.name for f in have), F.map_from_entries(lost).alias("raw")), missing


def copy_counts(copied: DataFrame, missing: list[str]) -> DataFrame:
    """One row for a copied table: rows, rows with values that stayed raw, and columns that the source lacks."""
    return copied.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("raw") > 0).alias("raw_rows"), F.lit(len(missing)).cast("long").alias("missing_columns"))


def copy_table(source: DataFrame, target: T.StructType, path: str) -> DataFrame:
    """Write :func:`copy_columns` as Parquet, and give the row of :func:`copy_counts`, counted while it was written."""
    copied, missing = copy_columns(source, target)
    seen = Observation()
    copied.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("raw") > 0).alias("raw_rows")).write.parquet(path)
    found = seen.get
    return source.sparkSession.createDataFrame([(found["rows"], found["raw_rows"], len(missing))], "rows long, raw_rows long, missing_columns long")


def export_dataset(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, meta, sample) per paper: its sections, their questions and subquestions as JSON, nested in order, and what is known of it.

    ``papers`` is (paper_id, paper_name, source_text, ai_source_text, raw_source_text, stored_question_count), ``questions``
    (paper_id, section, id, parent_id, sort_order, stem).  The meta has lengths and flags of the texts, which text the
    prediction comes from, and counts; a group counts its subquestions.  A paper without questions has no sample.
    """
    child = questions.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", F.col("id").alias("sub_id"), F.col("stem").alias("sub_stem")))).alias("subquestions"))
    roots = questions.where("parent_id IS NULL").join(child, "id", "left")
    one = F.struct("sort_order", "id", "stem", F.coalesce("subquestions", F.array().cast("array<struct<sort_order:bigint,sub_id:bigint,sub_stem:string>>")).alias("subquestions"))
    sections = roots.groupBy("paper_id", "section").agg(F.min("sort_order").alias("first"), F.array_sort(F.collect_list(one)).alias("questions"), F.sum(F.greatest(F.size(F.coalesce("subquestions", F.array())), F.lit(1))).alias("n"))
    nested = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first", "section", "questions"))).alias("sections"), F.sum("n").alias("n_questions"))
    rows = papers.join(nested, "paper_id")
    length, has = lambda c: F.length(F.coalesce(c, F.lit(""))), lambda c: F.coalesce(c, F.lit("")) != ""
    meta = F.struct(
        F.lit(1).alias("version"), "paper_id", "paper_name", length("source_text").alias("source_text_length"), length("ai_source_text").alias("ai_source_text_length"), has("ai_source_text").alias("has_ai_source_text"),
        F.when(has("ai_source_text"), "ai_source.txt").otherwise("source.txt").alias("prediction_source_file"), length("raw_source_text").alias("raw_source_text_length"), has("raw_source_text").alias("has_raw_source_text"),
        F.size("sections").alias("predicted_section_count"), F.col("n_questions").alias("predicted_question_count"), "stored_question_count",
    )
    return rows.select("paper_id", meta.alias("meta"), F.to_json(F.struct("paper_id", "sections")).alias("sample"))


#: Folders that a dataset's papers are dealt out over.
BUCKETS = 16


def write_dataset(samples: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write samples below ``path`` in folders by a hash of the paper; samples of a paper that comes again replace its older ones, and folders without new papers stay as they are.  Returns what is there then."""
    spark = samples.sparkSession
    new = samples.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = stored(new)
        old = spark.read.schema(new.schema).parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("paper_id").distinct(), "paper_id", "left_anti")
        new = stored(new.unionByName(old))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.schema(new.schema).parquet(path).drop("bucket")


def gold_template(questions: DataFrame) -> DataFrame:
    """Fields to label, from a prediction: version 1, status draft."""
    return questions.select("paper_id", "id", "section", "stem", F.lit(1).alias("version"), F.lit("draft").alias("label_status"))


def pick_sync_source(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(paper_id, source, used_gold): labelled gold, else the prediction, else gold."""
    rows = gold.select("paper_id", F.lit(True).alias("has_gold"), "label_status").join(pred.select("paper_id", F.lit(True).alias("has_pred")), "paper_id", "full")
    labelled = F.col("has_gold") & ~unlabelled(F.col("label_status"))
    source = F.when(F.coalesce(labelled, F.lit(False)), "gold").when(F.col("has_pred"), "prediction").otherwise("gold")
    return rows.select("paper_id", source.alias("source"), (source == "gold").alias("used_gold"))


#: States of labels that are as good as none (fixed values).
UNLABELLED = ("", "draft", "pending", "todo")


def unlabelled(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*UNLABELLED)


def dataset_summary(samples: DataFrame) -> DataFrame:
    """One row of samples (has_gold, has_prediction, has_source, label_status): all, with gold, with prediction, with source, unlabelled."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.count_if("has_gold").alias("gold"), F.count_if("has_prediction").alias("predictions"), F.count_if("has_source").alias("sources"), F.count_if(unlabelled(F.col("label_status"))).alias("unlabelled"))


def list_samples(samples: DataFrame, keyword: str | None = None) -> DataFrame:
    """Samples whose id, paper, subject or category has the keyword, last updated first, then by id."""
    found = samples
    if keyword and keyword.strip():
        has = F.lit(False)
        for c in ("id", "paper_name", "subject_name", "category_name"):
            has = has | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(keyword.strip().lower()))
        found = found.where(has)
    return found.orderBy(F.col("updated_at").desc_nulls_last(), "id")
