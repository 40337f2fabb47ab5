"""Registered queries; importing this package registers all of them."""

from tesserae.plans import catalog, evaluation, graphs, images, ingest, joins, prediction, registry, retrieval, sessions, statistics, texts

__all__ = ["catalog", "evaluation", "graphs", "images", "ingest", "joins", "prediction", "registry", "retrieval", "sessions", "statistics", "texts"]
