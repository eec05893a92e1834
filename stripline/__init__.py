"""Page-strip analytics on Spark: layout, safe cuts, composition, lineage, quality and text removal as DataFrame operators."""

import sys  # noqa: E402

from pyspark import cloudpickle  # noqa: E402

# Functions of this package travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
