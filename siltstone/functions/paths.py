"""Paths, file kinds and language support."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LanguageProvider:
    """What the engine knows of a language: its files, how to split them, and how far it is supported."""

    name: str
    extensions: tuple[str, ...]
    splittable: tuple[str, ...] = ()
    leaf: tuple[str, ...] = ()
    named: tuple[str, ...] = ()
    unwrap: tuple[str, ...] = ()
    max_lines: int = 50
    min_lines: int = 10
    status: str = "VALIDATED"
    indexer: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.extensions or any(not e.startswith(".") for e in self.extensions):
            raise ValueError(f"{self.name}: extensions start with a dot, and there is one at least")
        if self.min_lines > self.max_lines:
            raise ValueError(f"{self.name}: min_lines is above max_lines")


# Node kinds of the JavaScript and TypeScript grammars, and file kinds by extension.
SPLITTABLE = (
    "class_declaration", "method_definition", "if_statement", "for_statement", "while_statement", "switch_statement",
    "try_statement", "lexical_declaration", "function_declaration", "interface_declaration",
)
LEAF = ("public_field_definition", "private_field_definition", "protected_field_definition", "import_statement", "comment")
NAMED = (
    "class_declaration", "method_definition", "function_declaration", "public_field_definition", "private_field_definition",
    "protected_field_definition",
)
TYPESCRIPT = LanguageProvider("typescript", (".ts", ".tsx"), SPLITTABLE, LEAF, NAMED, indexer=("scip-typescript", "index"))
JAVASCRIPT = LanguageProvider("javascript", (".js", ".jsx", ".mjs"), SPLITTABLE, LEAF, NAMED, indexer=("scip-typescript", "index"))
PROVIDERS = (TYPESCRIPT, JAVASCRIPT)
TEXT_EXTENSIONS = (".md", ".mdx", ".yml", ".yaml")
CONFIG_EXTENSIONS = (".json",)
UNSUPPORTED = {
    "python": (".py", ".pyi"),
    "cpp": (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx"),
    "c": (".c", ".h"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "ruby": (".rb",),
    "php": (".php",),
    "csharp": (".cs",),
    "swift": (".swift",),
    "scala": (".scala",),
    "bash": (".sh", ".bash"),
}
STATUS_ORDER = ("VALIDATED", "EXPERIMENTAL", "UNSUPPORTED", "TEXT", "CONFIG", "IGNORED")


def registry(providers: tuple[LanguageProvider, ...] = PROVIDERS) -> dict[str, LanguageProvider]:
    """Providers by extension; an extension that two claim is an error."""
    out: dict[str, LanguageProvider] = {}
    for provider in providers:
        for ext in provider.extensions:
            if ext in out:
                raise ValueError(f"{ext} is claimed by {out[ext].name} and {provider.name}")
            out[ext] = provider
    return out


def provider_table(spark: SparkSession, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> DataFrame:
    rows = [(p.name, list(p.extensions), list(p.splittable), list(p.leaf), list(p.named), p.max_lines, p.min_lines, p.status) for p in providers]
    schema = "name string, extensions array<string>, splittable array<string>, leaf array<string>, named array<string>, max_lines int, min_lines int, status string"
    return spark.createDataFrame(rows, schema)


def all_extensions(providers: tuple[LanguageProvider, ...] = PROVIDERS) -> list[str]:
    return sorted({e for p in providers for e in p.extensions})


def validated_languages(providers: tuple[LanguageProvider, ...] = PROVIDERS) -> list[str]:
    return sorted(p.name for p in providers if p.status == "VALIDATED")


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def canonical(project: Column, relative: Column) -> Column:
    return posix(F.concat_ws("/", project, relative))


def name_of(path: Column) -> Column:
    """The last segment."""
    return F.element_at(F.split(posix(path), "/"), -1)


def ext_of(path: Column) -> Column:
    """The last dot of the last segment and what follows, lower-cased; a dot that begins the segment doesn't count."""
    return F.lower(F.regexp_extract(posix(path), r"[^/](\.[^./]*)$", 1))


def suffix_of(path: Column) -> Column:
    """Like ext_of with its case kept."""
    return F.regexp_extract(posix(path), r"[^/](\.[^./]*)$", 1)


def provider_for_ext(ext: Column, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> Column:
    """A provider's name from an extension, with or without its dot, in any case; else null."""
    dotted = F.lower(F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext)))
    pairs = [(e, p.name) for e, p in registry(providers).items()]
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*pairs)]), dotted)


def provider_for_path(path: Column, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> Column:
    ext = ext_of(path)
    return F.when(ext != "", provider_for_ext(ext, providers))


def classify(path: Column, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> Column:
    ext = ext_of(path)
    return (
        F.when(ext.isin(all_extensions(providers)), "CODE").when(ext.isin(*TEXT_EXTENSIONS), "TEXT").when(ext.isin(*CONFIG_EXTENSIONS), "CONFIG").otherwise("UNKNOWN")
    )


def language_support(path: Column, providers: tuple[LanguageProvider, ...] = PROVIDERS) -> Column:
    """Struct of `status` and `language`: how far the engine supports a file."""
    ext = ext_of(path)
    made = lambda status, language: F.struct(F.lit(status).alias("status"), F.lit(language).cast("string").alias("language"))
    out = F.when(F.lit(False), made("IGNORED", None))
    for provider in providers:
        out = out.when(ext.isin(*provider.extensions), made(provider.status, provider.name))
    for language, extensions in UNSUPPORTED.items():
        out = out.when(ext.isin(*extensions), made("UNSUPPORTED", language))
    return out.when(ext.isin(*TEXT_EXTENSIONS), made("TEXT", None)).when(ext.isin(*CONFIG_EXTENSIONS), made("CONFIG", None)).otherwise(made("IGNORED", None))
