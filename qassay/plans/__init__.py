"""Registered queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib

MODULES = ("corpus", "splits", "evaluation", "ranking", "cases", "costs", "interchange")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"qassay.plans.{name}")
