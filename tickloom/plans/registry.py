"""Every registered query with its SQL oracle, gathered from the modules of `tickloom.plans`."""

from __future__ import annotations

from importlib import import_module

MODULES = ("book_plans", "window_plans", "quality_plans", "etl_plans", "recon_plans", "sample_plans", "kernel_plans")


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        part = import_module(f"tickloom.plans.{name}").ALL
        assert not out.keys() & part.keys(), out.keys() & part.keys()
        out |= part
    return out


def entry(spark, sf_dir):
    return _all()["venue_spread_summary"][0](spark, sf_dir)


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
