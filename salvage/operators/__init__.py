"""Relational operators: scope, corpus, audits, ledgers, sinks."""
