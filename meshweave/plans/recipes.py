"""Recipes by name, and running one: ``python -m meshweave registry.json [id] [--prune] [--conf key=value]``.

The registry is a JSON object of recipe ids and ``module:function``. A function takes the
session, the settings and ``prune`` (a number of files for each concat axis, or None).
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Sequence


def load_registry(path: str) -> dict[str, str]:
    with open(path) as f:
        found = json.load(f)
    for name, where in found.items():
        if where.count(":") != 1:
            raise ValueError(f"recipe {name} must name a module and a function, not {where!r}")
    return found


def recipe(where: str):
    module, _, name = where.partition(":")
    return getattr(importlib.import_module(module), name)


def main(args: Sequence[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="meshweave")
    parser.add_argument("registry")
    parser.add_argument("id", nargs="*")
    parser.add_argument("--prune", nargs="?", const=2, type=int)
    parser.add_argument("--conf", action="append", default=[])
    given = parser.parse_args(args)
    known = load_registry(given.registry)
    if unknown := set(given.id) - known.keys():
        raise SystemExit(f"no recipe {', '.join(sorted(unknown))}")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("meshweave").getOrCreate()
    settings = dict(x.split("=", 1) for x in given.conf)
    done = []
    for name in given.id or known:
        recipe(known[name])(spark, settings, given.prune)
        done.append(name)
    return done
