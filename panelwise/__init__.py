"""panelwise: panel (entity x day) analytics expressed as Spark DataFrame plans.

Every analysis is a function ``DataFrame -> DataFrame`` parameterised by a
:class:`~panelwise.spec.PanelSpec` (entity, date, row id and metric column
names).  Nothing is collected to the driver except bounded, already aggregated
results (a handful of rows) where an API returns Python values.
"""

from panelwise.spec import PanelSpec, DEFAULT_SPEC

__all__ = ["PanelSpec", "DEFAULT_SPEC"]
__version__ = "0.1.0"
