"""All queries of the core library, by name."""

from __future__ import annotations

from turnstone.plans import frames, messages, reviews, scores

FLAGSHIP = "j12_threads"
QUERIES: dict = {**messages.QUERIES, **scores.QUERIES, **reviews.QUERIES, **frames.QUERIES}
ORACLES: dict = {**messages.ORACLES, **scores.ORACLES, **reviews.ORACLES, **frames.ORACLES}
