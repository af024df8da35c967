"""Operations of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Lets tasks run these functions where the package is not installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
