"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from webloom.llm import decontaminate, exact_dedup, fim, html_extract, licenses, lm, near, packing, quality, sharding, simhash, spelling, toxicity

MODULES = [html_extract, packing, decontaminate, sharding, lm, exact_dedup, toxicity, licenses, near, quality, spelling, simhash, fim]


def queries() -> dict:
    return {name: getattr(m, name) for m in MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v() if callable(v) else v for m in MODULES for k, v in m.SQL.items()}
