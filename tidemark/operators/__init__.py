"""Operators over command logs, versions, histories, traces and ledgers."""
