"""Scans and sinks: JSON corpora, stage tables, graphs as JSON or GraphML, plans, configurations."""

from .files import *  # noqa: F403
