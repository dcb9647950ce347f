"""Column functions: every one is a Catalyst expression, none is a UDF."""

from .market import *  # noqa: F403
from .scalars import *  # noqa: F403
