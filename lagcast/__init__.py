"""lagcast: arrival-delay analytics as Spark jobs.

Tables and streams of per-stop vehicle events go in; delay histories, typical
timetables, delay distributions, transfer probabilities, ranked itineraries and
walk-forward scores come out.  Every operator takes and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
