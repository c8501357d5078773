"""The registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from quarryline.queries import code, files, mining, patterns, ranges, records, selections

QUERIES = files.QUERIES | ranges.QUERIES | mining.QUERIES | code.QUERIES | patterns.QUERIES | records.QUERIES | selections.QUERIES
ORACLES = files.ORACLES | ranges.ORACLES | mining.ORACLES | code.ORACLES | patterns.ORACLES | records.ORACLES | selections.ORACLES
