"""Driver-side configuration and small files: validated settings, query files, citation maps, column names, published tables."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed as X


@dataclass(frozen=True)
class Settings:
    """Knobs of the workflow with their defaults; bad values are refused (SRC-10)."""

    seed: int = X.SEED
    stages: tuple[str, ...] = ("Early", "Middle", "Late")
    pca_share: float = X.PCA_SHARE
    pca_most: int = X.PCA_MOST
    clusters: int = X.CLUSTERS
    sensitivity: tuple[int, ...] = (3, 4, 5, 6)
    permutations: int = X.PERMUTATIONS
    fdr_q: float = X.FDR_Q
    bootstraps: int = X.BOOTSTRAPS
    bootstrap_share: float = X.BOOTSTRAP_SHARE
    seeds: int = X.SEEDS
    k_strategy: str = "fixed"
    alpha: float = 0.05
    terms: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        bad = [n for n, ok in (("pca_share", 0 < self.pca_share <= 1), ("clusters", self.clusters >= 2), ("permutations", self.permutations >= 1), ("fdr_q", 0 < self.fdr_q <= 1), ("bootstrap_share", 0 < self.bootstrap_share <= 1), ("alpha", 0 < self.alpha <= 1), ("k_strategy", self.k_strategy in ("fixed", "silhouette"))) if not ok]
        if bad:
            raise ValueError(f"settings out of range: {bad}")


def read_mapping(path: str) -> dict:
    """JSON, or YAML where its library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        got = json.loads(text)
    else:
        import yaml

        got = yaml.safe_load(text)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def load_settings(path: str) -> Settings:
    got = read_mapping(path)
    known = {f.name for f in fields(Settings)} - {"extra"}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in known}
    return Settings(**values, extra={k: v for k, v in got.items() if k not in known})


def load_query_file(path: str, required: Sequence[str] = ("queries",)) -> dict:
    """Search terms by id (SRC-11); white space in terms is folded (STR-15)."""
    got = read_mapping(path)
    missing = [k for k in required if k not in got]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    for q in got.get("queries") or []:
        q["term"] = " ".join(str(q.get("term", "")).split())
    return got


def load_references(path: str) -> dict[str, str]:
    """Citation keys and record ids, all non-empty (SRC-12)."""
    got = {str(k).strip(): str(v).strip() for k, v in read_mapping(path).items()}
    if any(not k or not v for k, v in got.items()):
        raise ValueError("a citation key or id is empty")
    return got


def resolve_columns(columns: Sequence[str], synonyms: dict[str, Sequence[str]], required: Sequence[str] = ()) -> dict[str, str]:
    """Column for every wanted name, without regard to case, the first synonym that exists (PRJ-07)."""
    by = {c.strip().lower(): c for c in reversed(columns)}
    found = {k: next(by[s.lower()] for s in (k, *names) if s.lower() in by) for k, names in synonyms.items() if any(s.lower() in by for s in (k, *names))}
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"columns are missing: {missing}; there are {list(columns)}")
    return found


def publish(df: DataFrame, base: str, run: str, tag: str = "latest") -> str:
    """Writes a run's table once and points a small file at it (SNK-06, SNK-07)."""
    path = f"{base}/{run}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(tag, path)], "tag string, path string").coalesce(1).write.mode("overwrite").json(f"{base}/_pointers/{tag}")
    return path


def published(spark: SparkSession, base: str, tag: str = "latest") -> DataFrame:
    return spark.read.parquet(spark.read.schema("tag string, path string").json(f"{base}/_pointers/{tag}").first().path)


def load_environment(path: str) -> dict[str, str]:
    """Settings of an environment file; what is set already stays (SRC-21)."""
    got = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.strip().removeprefix("export ").strip()
                if line and not line.startswith("#") and "=" in line:
                    k, _, v = line.partition("=")
                    got[k.strip()] = v.strip().strip("'\"")
    for k, v in got.items():
        os.environ.setdefault(k, v)
    return got


def run_config(parameters: dict, prompts: dict[str, str] | None = None, counts: dict[str, int] | None = None) -> dict:
    """What a run writes down of itself (SNK-04): parameters, SHA-256 of every prompt, versions, counts."""
    import hashlib
    import platform

    import pyspark

    hashes = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in (prompts or {}).items()}
    return {"parameters": parameters, "prompt_sha256": hashes, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}, "counts": counts or {}}


def lock_references(path: str, numbers: dict[str, int], records: dict[str, dict]) -> dict:
    """Writes the cited records in order of their numbers, whole or not at all (CIT-06); a key without a record is an error."""
    missing = sorted(set(numbers) - set(records))
    if missing:
        raise KeyError(f"no record of {missing}")
    got = {"references": [{"number": n, "cite_key": k, **records[k]} for k, n in sorted(numbers.items(), key=lambda x: x[1])]}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(got, f, indent=2, sort_keys=True, ensure_ascii=False)
    os.replace(f"{path}.part", path)
    return got
