"""Registry of the runnable queries and their SQL equivalents."""

from .basics import QUERIES as BASICS
from .interface import QUERIES as INTERFACE
from .replication import QUERIES as REPLICATION
from .retrieval import QUERIES as RETRIEVAL
from .upkeep import QUERIES as UPKEEP

REGISTRIES = [BASICS, RETRIEVAL, REPLICATION, INTERFACE, UPKEEP]
