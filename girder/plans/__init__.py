"""Operators bound to tables; importing a module registers its queries."""

from . import boq, commercial, curation, decisions, drawings, engineering, integrity, letters, networks, registers, retrieval, schedule, semantic, site, structure, texts, windows, works  # noqa: F401
