"""Audit of a corpus: which files count, how much they matter, and what there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import all_extensions, classify, ext_of, language_support, name_of, posix, suffix_of

# Fixed values of the audit.
IMPORTANT = ("package.json", "tsconfig.json", "webpack.config.js", "vite.config.ts", "next.config.js", "README.md")
EXCLUDED_GLOBS = (
    "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.test.ts", "*.spec.ts", "*.lock", "package-lock.json", "yarn.lock",
    ".DS_Store", "Thumbs.db",
)
DOC_MARKS = ("/**", "@param", "@returns", "@example", "# ")
KEYWORDS = ("class ", "interface ", "type ", "enum ", "function ", "const ", "let ", "import ", "require(")
CORE_DIRS = ("src", "lib", "core", "api", "components", "utils")
VALID_SUFFIXES = (*all_extensions(), ".md", ".mdx", ".json", ".yaml", ".yml")
MAX_SIZE, MAX_IMPORTANT_SIZE = 500_000, 1_000_000
HEAD_CHARS = 5000
MIN_SCORE = 5


def _globs() -> str:
    return "^(" + "|".join(g.replace(".", r"\.").replace("*", ".*") for g in EXCLUDED_GLOBS) + ")$"


def valid_file(path: Column, size: Column) -> Column:
    name = name_of(path)
    usual = suffix_of(path).isin(*VALID_SUFFIXES) & ~name.rlike(_globs()) & (size > 0) & (size <= MAX_SIZE)
    return F.when(name.isin(*IMPORTANT), size < MAX_IMPORTANT_SIZE).otherwise(usual)


def importance(path: Column, content: Column) -> Column:
    """Struct of `score`, `reasons` and `lines`, from the first 5000 characters; a null content scores nothing."""
    head = F.left(content, F.lit(HEAD_CHARS))
    has = lambda marks: F.array_compact(F.array(*[F.when(F.contains(head, F.lit(m)), F.lit(m)) for m in marks]))
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    exports, documented = F.contains(head, F.lit("export ")), F.size(has(DOC_MARKS)) > 0
    keywords = F.least(F.size(has(KEYWORDS)), F.lit(5))
    config = name_of(path).isin(*IMPORTANT)
    folders = F.split(posix(path), "/")
    core = F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(d) for d in CORE_DIRS]))
    point = lambda condition, n: F.when(condition, n).otherwise(0)
    score = point(exports, 3) + point(documented, 2) + keywords + point((lines > 10) & (lines < 1000), 1) + point(config, 5) + point(core, 2)
    reasons = F.array_compact(
        F.array(
            F.when(exports, "exports"), F.when(documented, "documented"), F.when(config, "critical_config"), F.when(core, "core_directory")
        )
    )
    nothing = F.struct(F.lit(0).alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit(0).alias("lines"))
    return F.when(content.isNull(), nothing).otherwise(F.struct(score.alias("score"), reasons.alias("reasons"), lines.alias("lines")))


def audited(files: DataFrame) -> DataFrame:
    """Valid files with score, reasons, lines, category, language and support. One scan, no shuffle."""
    path = F.col("relative_path")
    rows = files.where(valid_file(path, F.col("size"))).withColumn("_i", importance(path, F.col("content"))).withColumn("_s", language_support(path))
    return rows.select(
        *[c for c in files.columns if c != "content"], "_i.score", "_i.reasons", "_i.lines",
        classify(path).alias("category"), F.col("_s.language").alias("language"), F.col("_s.status").alias("support_status"),
    )


def kept(audit: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    return audit.where((F.col("score") >= min_score) | F.col("relative_path").endswith("README.md"))


#: Rows that the report and the view of a manifest show.
REPORT_ROWS, VIEW_ROWS = 20, 30


def ranked(audit: DataFrame, n: int | None = None) -> DataFrame:
    """Best first, then by path; the first n only if a number is given."""
    best = audit.orderBy(F.desc("score"), "relative_path")
    return best if n is None else best.limit(n)


def by_extension(audit: DataFrame) -> DataFrame:
    return audit.groupBy(ext_of(F.col("relative_path")).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext")


def typescript_files(audit: DataFrame) -> int:
    return audit.where(F.col("language") == "typescript").count()


def by_directory(audit: DataFrame, level: int = 1, n: int = 10) -> DataFrame:
    """The n largest directories at a level below the root, of files that lie deeper."""
    parts = F.split(posix(F.col("relative_path")), "/")
    rows = audit.where(F.size(parts) > level).groupBy(F.get(parts, F.lit(level - 1)).alias("dir"))
    return rows.agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(n)


def totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines"),
        F.round(F.coalesce(F.sum("size"), F.lit(0)) / (1024.0 * 1024.0), 6).alias("mib"),
    )


def primary_language(audit: DataFrame) -> DataFrame:
    """The most frequent validated language, ties to the first by name."""
    rows = audit.where(F.col("support_status") == "VALIDATED").groupBy("language").agg(F.count("*").alias("files"))
    return rows.orderBy(F.desc("files"), "language").limit(1)
