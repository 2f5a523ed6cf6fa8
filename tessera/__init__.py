"""tessera: a Spark-native tabular trainer and profiler.

Read a table, profile it, clean and encode it, split it exactly and run one of
five tasks (classification, regression, clustering, anomaly detection,
dimensionality reduction) as DataFrame expressions and ``pyspark.ml`` stages.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Let Python workers run tessera's UDFs without the package installed:
    functions defined in this package are pickled by value, not by import path."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
