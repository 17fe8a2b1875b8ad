"""Imports every catalog module so its queries register."""

from flowlens.plans import catalog_core  # noqa: F401
from flowlens.plans import catalog_ops  # noqa: F401
from flowlens.plans import catalog_analytics  # noqa: F401
from flowlens.plans import catalog_shapes  # noqa: F401
from flowlens.plans import catalog_derive  # noqa: F401
from flowlens.plans import catalog_more  # noqa: F401
from flowlens.plans import catalog_io  # noqa: F401
from flowlens.plans import catalog_stores  # noqa: F401
