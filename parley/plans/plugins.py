"""Extension points: registries of templates, tool formats, rewards and transforms, and plug-ins by path."""

from __future__ import annotations

import importlib.util
from pathlib import Path
from types import ModuleType

from pyspark.sql import SparkSession

from parley.operators.agent import FORMATS
from parley.operators.render import TEMPLATES, WEIGHT_MAPS
from parley.operators.rewards import REWARDS
from parley.operators.transforms import TRANSFORMS

REGISTRIES = {"template": TEMPLATES, "tool format": FORMATS, "reward": REWARDS, "transform": TRANSFORMS, "loss weights": WEIGHT_MAPS}


def register(kind: str, name: str, value, exist_ok: bool = False) -> None:
    if name in REGISTRIES[kind] and not exist_ok:
        raise ValueError(f"the {kind} {name} exists")
    REGISTRIES[kind][name] = value


def load_plugin(spark: SparkSession, path: str) -> ModuleType:
    """Imports a Python file here and makes it importable on executors."""
    spark.sparkContext.addPyFile(path)
    name = Path(path).stem
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module
