"""Panel (entity x period) analytics and surrogate modelling on Spark DataFrames."""

from panelloom.spec import PanelSpec

__all__ = ["PanelSpec"]
