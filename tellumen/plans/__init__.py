"""Query registry: registry.py holds the table, the other modules add to it."""

from tellumen.plans import registry  # noqa: F401
from tellumen.plans import panel_queries  # noqa: F401
from tellumen.plans import score_queries  # noqa: F401
from tellumen.plans import io_queries  # noqa: F401
from tellumen.plans import audit_queries  # noqa: F401
