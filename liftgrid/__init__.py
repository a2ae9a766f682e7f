"""liftgrid: randomized-experiment and uplift analytics as Spark DataFrame operators."""

from liftgrid.spec import ExperimentSpec

__all__ = ["ExperimentSpec"]
