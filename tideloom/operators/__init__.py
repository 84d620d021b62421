"""All declarative operators; importing this package registers them."""

from . import alerts, allpairs, coordination, fingerprints, graphs, insights, matrices, narratives, relational, temporal, vectors  # noqa: F401
