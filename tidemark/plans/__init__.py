"""Queries by area; importing this package fills the registry."""

from tidemark.plans import analysis, extra, flows, histories, indicators, maintenance, market, store, strategies, streams, text, trading  # noqa: F401
