"""postlens: Spark-native analytics for collections of short social posts.

Read posts (``sources``), run an analysis (``operators.analyses`` or
``plans.run`` by name), derive chart data (``operators.charts``), classify
sentiment (``operators.classifier``), capture from a landing directory
(``streaming``), and write results (``sinks``). Every operator takes and
returns a lazy DataFrame.
"""

__version__ = "0.1.0"
