"""Registered queries; importing the modules fills the registry."""

from .registry import QUERIES  # noqa: F401
from . import q_functions  # noqa: F401,E402
from . import q_tables  # noqa: F401,E402
from . import q_rasters  # noqa: F401,E402
from . import q_selection, q_features, q_evaluation, q_explain, q_sources  # noqa: F401,E402
