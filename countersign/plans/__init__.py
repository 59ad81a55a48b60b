"""Whole jobs made of sources and operators, and the registered queries."""

from countersign.plans.ingest import load_transactions

__all__ = ["load_transactions"]
