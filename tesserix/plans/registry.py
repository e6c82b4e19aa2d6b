"""All registered queries: name -> (Spark callable, SQL check or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_lookup", "q_address", "q_directory", "q_archive", "q_payload", "q_reads", "q_features", "q_ingest", "q_sketches"]


def all_queries() -> dict:
    out = {}
    for name in MODULES:
        out.update(import_module(f"tesserix.plans.{name}").QUERIES)
    return out
