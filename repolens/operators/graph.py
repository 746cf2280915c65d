"""The import graph: relative specifiers resolved to files of the same run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_path, parent_folder
from .lines import parse_strategy

# What is tried after a specifier, in this order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]


def import_targets(files: DataFrame) -> DataFrame:
    """(run_id, base, target): for each path without one of the suffixes the first file, in their order, that a
    specifier of that base means. A path ends with three of them at most: nothing, an extension, an index file."""
    path, whole = F.col("path"), F.length("path")
    ends = [F.when(path.endswith(s), F.struct(F.lit(i).alias("rank"), F.substring(path, F.lit(1), whole - len(s)).alias("base"))) for i, s in enumerate(SUFFIXES)]
    found = files.select("run_id", "path", "file_id", F.explode(F.filter(F.array(*ends), lambda e: e.isNotNull())).alias("e"))
    first = F.min(F.struct("e.rank", "path", "file_id")).alias("target")
    return found.groupBy("run_id", F.col("e.base").alias("base")).agg(first)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`imports(run_id, file_id, import_id, source, kind, line)` with source_path, target_file_id and
    target_path.

    Only files with a syntax tree and specifiers that begin with `./` or `../` are resolved. An import is one row of
    the join, whatever may follow its specifier: `import_targets` has one row for what it can mean. Others get
    keys of their own, which no path equals and which no task collects. (run_id, path) names a file.
    """
    paths = files.select("run_id", "file_id", F.col("path").alias("source_path"), "language")
    known = imports.join(paths, ["run_id", "file_id"], "left")
    relative = (parse_strategy(F.col("language")) == "ast") & (F.col("source").startswith("./") | F.col("source").startswith("../"))
    base = normal_path(F.concat_ws("/", parent_folder(F.col("source_path")), "source"))
    none = F.concat(F.lit("\0"), F.coalesce(F.col("import_id").cast("string"), F.lit("")))
    asked = known.withColumn("base", F.when(relative, base).otherwise(none)).drop("language")
    found = asked.join(import_targets(files), ["run_id", "base"], "left").drop("base")
    return found.withColumns({"target_file_id": F.col("target.file_id"), "target_path": F.col("target.path")}).drop("target")


def dependency_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each import: source and target file, external if there is no target."""
    found = resolve_imports(imports, files)
    return found.select("run_id", "import_id", F.col("file_id").alias("source_file_id"), "target_file_id", F.col("target_file_id").isNull().alias("external"), "kind", F.col("source").alias("specifier"))
