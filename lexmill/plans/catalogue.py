"""All registered queries: importing the modules registers them."""

from __future__ import annotations

from lexmill.operators import aggregates, candidates, claims, cleaning, contexts, duplicates, expressions, gate, matching, numbers, planning, practice, quotes, rating, records, replies, routing, rules, scoring, solutions, trimming, units, verify, widening
from lexmill.sources import files
from lexmill.streaming import jobs, status

from .registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "aggregates", "candidates", "claims", "cleaning", "contexts", "duplicates", "expressions", "files", "gate", "jobs", "matching", "numbers", "planning", "practice", "quotes", "rating", "records", "replies", "routing", "rules", "scoring", "status", "solutions", "trimming", "units", "verify", "widening"]

FLAGSHIP = units.chunk_quality
