"""Sources and sinks: panel readers, persistence and the driver-table views."""

from panelwise.sources.panel_io import (  # noqa: F401
    PanelSourceError,
    read_panel_csv,
    read_panel_parquet,
    require_path,
    persist_prepared,
    write_prepared,
)
from panelwise.sources.driver_views import (  # noqa: F401
    PANEL_VIEW_TEMPLATE,
    EVENTS_VIEW_TEMPLATE,
    panel_view,
    events_view,
    load_tables,
)
from panelwise.sources.prepared import PreparedTable, drop_prepared, keep_prepared  # noqa: F401
