"""Registered queries: every operator over the given tables, with a SQL twin."""

from __future__ import annotations

from functools import lru_cache

from .common import Registry


@lru_cache(maxsize=1)
def build() -> Registry:
    from . import bar_queries, gate_queries, indicator_queries, metric_queries, rule_queries, score_queries, sink_queries, trade_queries

    reg = Registry()
    for module in (bar_queries, indicator_queries, rule_queries, trade_queries, metric_queries, score_queries, gate_queries, sink_queries):
        module.register(reg)
    return reg
