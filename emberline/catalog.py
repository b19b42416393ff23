"""All registered queries of the library and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["event_plans", "profile_plans", "scene_plans", "raster_plans", "review_plans", "link_plans", "file_plans", "scan_plans"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"emberline.plans.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"emberline.plans.{m}").ORACLES.items()}
