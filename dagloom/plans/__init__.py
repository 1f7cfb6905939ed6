"""Bulk plans and the registered queries. Importing the package registers all of them."""

from dagloom.plans import catalog, ledger_catalog  # noqa: F401
