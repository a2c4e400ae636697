"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

import importlib
import pkgutil

from storyflow import plans
from storyflow.plans.data import Data
from storyflow.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"storyflow.plans.{_m}")


def queries():
    return {name: (lambda spark, folder, fn=fn: fn(Data(spark, folder))) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
