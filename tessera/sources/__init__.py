from tessera.sources.tables import TABLES, table, scan, scan_many

__all__ = ["TABLES", "table", "scan", "scan_many"]
