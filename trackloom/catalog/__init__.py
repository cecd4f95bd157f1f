"""Registered queries: every operator run over the given tables, with its SQL twin where one exists."""

from __future__ import annotations

import importlib

from trackloom.catalog.registry import ENTRIES, Entry

AREAS = ("names", "space", "joining", "ensembles", "scoring", "tracks", "behaviour", "geometry", "latent",
         "clusters", "selection", "tables", "files", "whole")


def entries() -> dict[str, Entry]:
    for area in AREAS:
        importlib.import_module(f"trackloom.catalog.{area}")
    return ENTRIES
