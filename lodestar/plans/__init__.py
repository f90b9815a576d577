"""Registered queries. Importing this package fills the catalog."""

from importlib import import_module

MODULES = ("tpch", "scalar", "relational", "market", "semi", "formats")

for _name in MODULES:
    import_module(f"{__name__}.{_name}")
