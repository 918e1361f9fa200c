"""All registered queries; importing the families fills the registry."""
from parleo.catalog.base import ORACLES, QUERIES  # noqa: F401
from parleo.catalog import turns  # noqa: F401
from parleo.catalog import conduct  # noqa: F401
from parleo.catalog import entities  # noqa: F401
from parleo.catalog import affect  # noqa: F401
from parleo.catalog import series  # noqa: F401
from parleo.catalog import dashboard  # noqa: F401
from parleo.catalog import mining  # noqa: F401
from parleo.catalog import records  # noqa: F401
from parleo.catalog import streams  # noqa: F401
