"""Queries on the test tables."""

from . import checks, corpus, grammar, myanmar, probes, script

MODULES = (corpus, checks, myanmar, script, grammar, probes)
