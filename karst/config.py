"""Settings from karst.json, karst.jsonc or karst.toml: where tables lie, where migrations lie, Spark's settings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

NAMES = ("karst.json", "karst.jsonc", "karst.toml")


@dataclass(frozen=True)
class Config:
    root: str | None = None
    migrations: str = "migrations"
    schema: str | None = None  # a Python file with a Model called MODEL
    spark: dict[str, str] = field(default_factory=dict)


def without_comments(text: str) -> str:
    """JSON text without // and /* */ comments and trailing commas, strings left alone."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept)


def load(path: str | Path | None = None, start: str | Path = ".") -> Config:
    """The given file, or the first found in start and the folders above it; the defaults if there is none."""
    if path is None:
        above = [Path(start).resolve(), *Path(start).resolve().parents]
        path = next((p / n for p in above for n in NAMES if (p / n).is_file()), None)
        if path is None:
            return Config()
    path = Path(path)
    if path.suffix == ".toml":
        import tomllib

        raw = tomllib.loads(path.read_text())
    else:
        raw = json.loads(without_comments(path.read_text()))
    if unknown := set(raw) - set(Config.__dataclass_fields__):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return Config(**raw)


def session(config: Config):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("karst").config("spark.sql.session.timeZone", "UTC")
    for k, v in config.spark.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def model(config: Config):
    """The schema that the settings name."""
    from .plans.ddl import Model

    if not config.schema:
        return Model()
    scope: dict = {"__name__": "karst_schema"}
    exec(compile(Path(config.schema).read_text(), config.schema, "exec"), scope)
    return scope["MODEL"]
