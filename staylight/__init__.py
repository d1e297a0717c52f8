"""Outcome-risk analytics on Spark: clean, explain, train, score and log at any table size."""

from staylight.bindings import ACCOUNTS, DOCUMENTS, HR
from staylight.spec import PanelSpec

__all__ = ["ACCOUNTS", "DOCUMENTS", "HR", "PanelSpec"]
