"""Registered queries over the driver tables, each beside its oracle SQL."""

import importlib
import pkgutil


def load():
    """Import every plan module once; returns (queries, oracles)."""
    from . import base
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return base.QUERIES, base.ORACLES
