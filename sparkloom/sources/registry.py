"""The kinds of sources that can be built from a configuration."""

from __future__ import annotations

from .base import Registry, Spec
from .catalog import CatalogAdapter
from .postgres import PostgresAdapter
from .sqlite import SqliteAdapter

REGISTRY = Registry()
REGISTRY.register(Spec("spark", lambda spark, c: CatalogAdapter(spark, c.get("database"))))
REGISTRY.register(Spec("sqlite", lambda spark, c: SqliteAdapter(spark, c["path"]), ("path",)))
REGISTRY.register(Spec("postgres", lambda spark, c: PostgresAdapter(spark, c["url"], {k: v for k, v in c.items() if k in ("user", "password", "driver")}), ("url",), ("password",)))
