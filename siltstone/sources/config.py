"""Settings from an INI file."""

from __future__ import annotations

import configparser
import importlib.util
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    project: str = "proj"
    source_root: str = ""
    store_root: str = ""
    min_score: int = 5
    query_prefix: str = ""
    card_results: int = 3
    chunk_results: int = 4
    graph_backend: str = "scip"


def missing_keys(path: str) -> list[str]:
    """Settings that a file doesn't give: their defaults count."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return sorted({f.name for f in fields(Settings)} - set(parser.defaults()))


def missing_modules(names: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas", "xxhash")) -> list[str]:
    """Modules that the engine needs and Python doesn't find."""
    return sorted(n for n in names if importlib.util.find_spec(n) is None)


def load_settings(path: str) -> Settings:
    """Known keys of the [DEFAULT] section, in any case; others are left alone. A missing file is an error."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    values = {f.name: parser.defaults()[f.name] for f in fields(Settings) if f.name in parser.defaults()}
    return Settings(**{k: type(getattr(Settings, k))(v) for k, v in values.items()})
