"""Source adapters: what a system holds, as DataFrames of objects, columns, dependencies, definitions, lineage and query events."""
