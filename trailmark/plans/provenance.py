"""Run provenance and guards on paths and parameters, on the driver before any work starts."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import platform
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.identity import UNKNOWN_MODEL


def file_sha256(path: Path) -> str:
    with path.open("rb") as data:
        return hashlib.file_digest(data, "sha256").hexdigest()


def path_errors(inputs: list[Path], outputs: list[Path], frozen: list[Path]) -> list[str]:
    """Outputs must differ from each other and from inputs and lie outside frozen folders."""
    out = [p.resolve() for p in outputs]
    errors = [f"output given twice: {p}" for i, p in enumerate(out) if p in out[:i]]
    errors += [f"output is an input: {p}" for p in out if p in [i.resolve() for i in inputs]]
    errors += [f"output in a frozen folder: {p}" for p in out for f in frozen if p.is_relative_to(f.resolve())]
    return errors


def class_errors(actual: Mapping[int, str], expected: Mapping[int, str]) -> list[str]:
    """Ids must be the same, then names, blanks and case aside."""
    if set(actual) != set(expected):
        return [f"class ids {sorted(actual)} are not {sorted(expected)}"]
    plain = lambda s: s.strip().lower()
    return [f"class {k} is {actual[k]!r}, not {expected[k]!r}" for k in sorted(expected) if plain(actual[k]) != plain(expected[k])]


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict:
    versions = {}
    for name in packages:
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    return {"python": platform.python_version(), "platform": platform.platform(), "packages": versions}


#: The parameters of a run, as the document names them.
PARAMETERS = ("confidence", "iou", "imageSize", "end2end")


def run_documents(runs: DataFrame, registry: DataFrame, canonical: DataFrame) -> DataFrame:
    """Add ``document``: what was run on what, with which parameters, and how they differ from the canonical ones, as JSON.

    ``runs`` has source_path, source_sha256, model_path, model_sha256, classes (map<string, string>), result (struct),
    created_at and the PARAMETERS; ``registry`` sha256, experiment and status; ``canonical`` one row of the PARAMETERS.
    The keys of the document are fixed values.
    """
    known = registry.groupBy(F.lower("sha256").alias("__sha")).agg(F.min(F.struct("experiment", "status")).alias("__m"))
    standard = canonical.first()
    changed = [
        F.when(~F.col(p).eqNullSafe(F.lit(standard[p])), F.struct(F.lit(standard[p]).alias("canonical"), F.col(p).alias("actual"))).alias(p) for p in PARAMETERS
    ]
    same = F.lit(True)
    for p in PARAMETERS:
        same = same & F.col(p).eqNullSafe(F.lit(standard[p]))
    named = lambda field: F.coalesce(f"__m.{field}", F.lit(UNKNOWN_MODEL)).alias(field)
    machine = F.from_json(F.lit(json.dumps(environment())), "python string, platform string, packages map<string, string>")
    document = F.struct(
        F.lit(1).alias("schemaVersion"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("createdAtUtc"),
        F.struct(F.col("source_path").alias("path"), F.col("source_sha256").alias("sha256")).alias("source"),
        F.struct(F.col("model_path").alias("path"), F.col("model_sha256").alias("sha256"), named("experiment"), named("status")).alias("model"),
        F.struct(*PARAMETERS, same.alias("canonicalInference"), F.struct(*changed).alias("overrides")).alias("inference"),
        "classes",
        machine.alias("environment"),
        "result",
    )
    joined = runs.join(known, F.lower("model_sha256") == F.col("__sha"), "left")
    return joined.withColumn("document", F.to_json(document)).drop("__sha", "__m")
