"""The queries by name; importing the package registers all of them."""

from . import catalog, extended, structured  # noqa: F401
