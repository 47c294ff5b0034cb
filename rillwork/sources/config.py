"""Settings trees with ``{name}`` in their texts."""

from __future__ import annotations

import os
import re
import tempfile
from typing import Any

from pyspark.sql import SparkSession


def expanded(tree: Any, names: dict[str, str]) -> Any:
    """``tree`` with ``{name}`` filled in everywhere; unknown names stay."""
    if isinstance(tree, dict):
        return {k: expanded(v, names) for k, v in tree.items()}
    if isinstance(tree, list):
        return [expanded(v, names) for v in tree]
    if isinstance(tree, str):
        for name, value in names.items():
            tree = tree.replace("{" + name + "}", value)
        return os.path.expanduser(tree) if tree.startswith("~") else tree
    return tree


def settings(tree: dict) -> dict:
    """Fills in the tree's own top-level texts."""
    return expanded(tree, {k: os.path.expanduser(v) for k, v in tree.items() if isinstance(v, str)})


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only where Spark is one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rillwork-")
    return root.rstrip("/")
