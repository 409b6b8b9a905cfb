"""Every operator as a registered query."""

from loupe.suite import cleaning, distribution, modelling, plans, preparing, profiling, relationship, trend  # noqa: F401
from loupe.suite.registry import QUERIES, SQL  # noqa: F401
