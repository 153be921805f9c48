"""All registered queries and the SQL they are checked against."""

from saleslens.catalog.base import QUERIES, SQL  # noqa: F401
from saleslens.catalog import dashboard, features, modelling, profiling  # noqa: F401
