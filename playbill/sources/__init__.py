"""Landed payloads to rows of one schedule; importing either module registers the sources of both."""

from . import feeds, pages  # noqa: F401
