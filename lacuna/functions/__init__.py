"""Column functions: names, coordinates, calendar, distances."""

from .scalars import *  # noqa: F401,F403
