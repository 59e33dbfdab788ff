"""Registered queries by topic."""

import importlib

TOPICS = ("columns", "pages", "extraction", "discovery", "feed", "quality", "streams")


def load_all() -> None:
    for topic in TOPICS:
        importlib.import_module(f"shelfspark.queries.{topic}")
