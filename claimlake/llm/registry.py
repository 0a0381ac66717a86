"""All queries of the subpackage and their SQL."""

from claimlake.llm import queries_models, queries_native, queries_records, queries_search  # noqa: F401
from claimlake.llm.common import QUERIES, SQL  # noqa: F401
