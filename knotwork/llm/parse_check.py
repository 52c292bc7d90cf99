"""Source files that do not parse, per file and as rates per repository and language (problem 1).

The language is that of the extension of ``code_path`` in any case. Every file is lexed and parsed to its end by the
table-driven parsers of :mod:`knotwork.llm.syntax`; each file gives one row with the first unrecoverable error or
null. The work is one pass over the table without a shuffle, so a repository that holds a third of all files is
spread like any other; rates are pre-aggregated before their shuffle.

Defined results: null ``code`` or null ``code_path`` or an extension outside the six gives no verdict (no row); empty
py, js and java files are valid, empty json, ipynb and xml files are not; texts of any length are parsed whole;
repeated rows give repeated verdicts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.syntax.files import LANGUAGES, first_error

VERDICT = "file_id long, stored_dir_name string, code_path string, language string, error_line int, error string"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines, messages = [], []
        for language, code in zip(b.column("language").to_pylist(), b.column("code").to_pylist(), strict=True):
            found = first_error(language, code)
            lines.append(found[0] if found else None)
            messages.append(found[1] if found else None)
        keep = ["file_id", "stored_dir_name", "code_path", "language"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lines, pa.int32()), pa.array(messages, pa.string())], [*keep, "error_line", "error"])


def verdicts(repo: DataFrame) -> DataFrame:
    """One row per parsable file: its language, and the line and message of its first error or nulls."""
    language = F.lower(F.regexp_extract("code_path", r"\.([A-Za-z]+)$", 1))
    files = repo.select("file_id", "stored_dir_name", "code_path", language.alias("language"), "code")
    files = files.filter(F.col("language").isin(*LANGUAGES) & F.col("code").isNotNull())
    return files.mapInArrow(_verdicts, VERDICT)


def found(repo: DataFrame) -> DataFrame:
    """file_id of every file that does not parse."""
    return verdicts(repo).filter(F.col("error").isNotNull()).select("file_id").distinct()


def rates(repo: DataFrame) -> DataFrame:
    """Files, broken files and their share per repository and language."""
    broken = F.count("error")
    return verdicts(repo).groupBy("stored_dir_name", "language").agg(
        F.count(F.lit(1)).alias("files"), broken.alias("broken"), F.round(broken / F.count(F.lit(1)), 6).alias("rate")
    )


def reported(repo: DataFrame, metadata: DataFrame) -> DataFrame:
    """Broken files with their error, and whether an ``err_msg`` of the repository names the file.

    A message names a file by its name, or by a path that ends like that of the file or the other way round. The names
    are cut out of the messages and met by equality, each once per repository, so neither a repository with very many
    messages nor one with very many files makes pairs.
    """
    bad = verdicts(repo).filter(F.col("error").isNotNull()).withColumn("name", F.element_at(F.split("code_path", "/"), -1))
    words = F.regexp_extract_all(F.replace("err_msg", F.lit("\\"), F.lit("/")), F.lit(rf"([\w./~-]*[\w-]\.(?i:{'|'.join(LANGUAGES)}))\b"), F.lit(1))
    told = metadata.filter(F.col("err_msg").isNotNull()).select(F.col("dir_name").alias("stored_dir_name"), F.explode(words).alias("word")).distinct()
    told = told.withColumn("name", F.element_at(F.split("word", "/"), -1))
    path = F.concat(F.lit("/"), F.col("code_path"))
    same = F.endswith(path, F.concat(F.lit("/"), F.ltrim(F.col("word"), F.lit("./~")))) | F.endswith(F.col("word"), path)
    met = bad.join(told, ["stored_dir_name", "name"]).filter(same).select("file_id").distinct().withColumn("is_reported", F.lit(True))
    return bad.join(met, "file_id", "left").select("file_id", "stored_dir_name", "language", "error_line", "error", F.coalesce("is_reported", F.lit(False)).alias("is_reported"))
