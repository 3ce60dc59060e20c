"""Where panels come from and where results go."""

from panelytics.sources.csv_panels import find_csv, read_csv_panel
from panelytics.sources.sinks import export, write_panel
from panelytics.sources.tables import register, run_sql, show_sql

__all__ = ["export", "find_csv", "read_csv_panel", "register", "run_sql", "show_sql", "write_panel"]
