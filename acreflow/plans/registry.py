"""All registered queries of the land-analytics operators and their SQL."""

from __future__ import annotations

from . import auctions, relational, spatial, textvalue

QUERIES: dict = {**relational.QUERIES, **textvalue.QUERIES, **spatial.QUERIES, **auctions.QUERIES}
ORACLES: dict = {**relational.ORACLES, **textvalue.ORACLES, **spatial.ORACLES, **auctions.ORACLES}
