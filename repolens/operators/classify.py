"""Pruning, names, languages and categories of files."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension_of, file_name

# Folder names that are pruned, and the names and extensions of each category.
IGNORED_FOLDERS = [".git", "node_modules", ".next", "dist", "build", "coverage", ".cache", "venv", ".venv", "__pycache__", "target", "vendor"]

GENERATED_NAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock", "go.sum"]
GENERATED_ENDS = [".min.js", ".min.css", ".map"]
DOCUMENTATION_NAMES = [
    "README", "README.MD", "LICENSE", "LICENSE.MD", "CHANGELOG", "CHANGELOG.MD", "CONTRIBUTING", "CONTRIBUTING.MD",
    "AUTHORS", "NOTICE", "CODE_OF_CONDUCT", "CODE_OF_CONDUCT.MD",
]
CONFIG_NAMES = [
    "package.json", "tsconfig.json", "tsconfig.base.json", ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs",
    ".prettierrc", ".prettierrc.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", ".gitignore",
    ".dockerignore", ".npmrc", ".env.example", "next.config.ts", "next.config.js", "next.config.mjs", "vite.config.ts",
    "tailwind.config.ts", "turbo.json", "pnpm-workspace.yaml", "Gemfile", "requirements.txt", "Pipfile", "go.mod",
    "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts",
]
DOCUMENTATION_EXTENSIONS = [".md", ".mdx", ".rst", ".txt"]
CONFIG_EXTENSIONS = [".yml", ".yaml", ".toml", ".ini", ".cfg", ".conf"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".bmp", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib", ".o", ".class", ".jar", ".war", ".pyc",
    ".mp3", ".mp4", ".mov", ".avi", ".wav", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".db", ".sqlite",
]
LANGUAGES = {
    "TypeScript": [".ts", ".tsx"], "JavaScript": [".js", ".jsx", ".mjs", ".cjs"], "Python": [".py"], "Java": [".java"],
    "C": [".c", ".h"], "C++": [".cpp", ".cc", ".cxx", ".hpp"], "Go": [".go"], "Rust": [".rs"], "Ruby": [".rb"],
    "PHP": [".php"], "C#": [".cs"], "Kotlin": [".kt", ".kts"], "Swift": [".swift"], "HTML": [".html", ".htm"],
    "CSS": [".css", ".scss", ".sass", ".less"], "SQL": [".sql"], "Shell": [".sh", ".bash", ".zsh"],
}


def in_ignored_folder(path: Column) -> Column:
    """Whether a folder above the file has an ignored name; the file's own name does not count."""
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(x) for x in IGNORED_FOLDERS]))


def language_of(extension: Column) -> Column:
    pairs = [(e, name) for name, ends in LANGUAGES.items() for e in ends]
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)]), F.lower(extension))


def category_of(name: Column, extension: Column) -> Column:
    ext = F.lower(F.coalesce(extension, F.lit("")))
    generated = name.isin(GENERATED_NAMES)
    for end in GENERATED_ENDS:
        generated = generated | name.endswith(end)
    return (
        F.when(generated, "GENERATED")
        .when(F.upper(name).isin(DOCUMENTATION_NAMES), "DOCUMENTATION")
        .when(name.isin(CONFIG_NAMES), "CONFIG")
        .when(language_of(ext).isNotNull(), "SOURCE")
        .when(ext.isin(DOCUMENTATION_EXTENSIONS), "DOCUMENTATION")
        .when(ext.isin(CONFIG_EXTENSIONS), "CONFIG")
        .when(ext.isin(BINARY_EXTENSIONS), "BINARY")
        .otherwise("DATA")
    )


def classify(files: DataFrame) -> DataFrame:
    """`files(path, ...)` outside ignored folders, with name, extension, category, language (of source
    files only), is_source and is_ignored. No shuffle."""
    named = files.where(~in_ignored_folder(F.col("path"))).withColumn("name", file_name(F.col("path")))
    known = named.withColumn("extension", extension_of(F.col("name"))).withColumn("category", category_of(F.col("name"), F.col("extension")))
    source = F.col("category") == "SOURCE"
    return known.withColumns({
        "language": F.when(source, language_of(F.col("extension"))),
        "is_source": source,
        "is_ignored": F.col("category") == "IGNORED",
    })


def ingestion_summary(files: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, file_count, source_file_count) over `classify`."""
    return files.groupBy(by).agg(F.count("*").alias("file_count"), F.count_if("is_source").alias("source_file_count"))
