from modelloom.sources.tables import export, load_table, preview, stage

__all__ = ["export", "load_table", "preview", "stage"]
