"""Column expressions, grouped by theme."""

from .features import *  # noqa: F401,F403
from .numbers import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .time import *  # noqa: F401,F403
