"""File-parity analytics on Spark: is every file of a source byte-intact on its backups, and what is there twice?"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.duplicates import duplicate_items, duplicate_totals, find_duplicates  # noqa: E402
from .operators.inventory import Destination, admitted, fingerprint_content, from_content  # noqa: E402
from .operators.match import fold_verdicts, match, verdicts  # noqa: E402
from .operators.summary import summarize  # noqa: E402

__all__ = [
    "Destination",
    "admitted",
    "duplicate_items",
    "duplicate_totals",
    "find_duplicates",
    "fingerprint_content",
    "fold_verdicts",
    "from_content",
    "match",
    "summarize",
    "verdicts",
]
