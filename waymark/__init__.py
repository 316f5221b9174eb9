"""waymark: sensor-detection mobility analytics as Spark DataFrame functions."""

from waymark.params import CAMPUS, DISTRICT, MAINTAINED, MetricParams

__all__ = ["CAMPUS", "DISTRICT", "MAINTAINED", "MetricParams"]
