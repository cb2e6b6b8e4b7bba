"""All registered queries."""

from __future__ import annotations

import importlib

from hushlake.plans.registry import ORACLES, QUERIES

MODULES = ("text_queries", "vault_queries", "region_queries", "record_queries", "policy_queries", "history_queries", "pixel_queries", "bundle_queries", "stream_queries")

for _module in MODULES:
    importlib.import_module(f"hushlake.plans.{_module}")

__all__ = ["QUERIES", "ORACLES"]
