"""All queries: importing the modules fills the registry."""

from floodlens.plans import (  # noqa: F401
    class_queries, geo_queries, normalizer_queries, payload_queries, risk_queries, serving_queries, stream_queries, text_queries,
    tide_queries,
)
from floodlens.plans.registry import ORACLES, QUERIES  # noqa: F401
