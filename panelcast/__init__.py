"""Panel forecasting on Spark DataFrames."""

from panelcast.spec import PanelSpec

__all__ = ["PanelSpec"]
