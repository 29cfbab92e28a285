"""Texts with references, made from orders by the same SQL on every engine."""

from __future__ import annotations

CASE = "concat('C-', o_orderkey % 999 + 1, '/', lpad(cast(year(o_orderdate) % 100 as string), 2, '0'))"
COURT = "concat('T-', o_custkey % 99 + 1, '/04')"
JOURNAL = "concat('OJ L ', o_custkey % 400 + 1, ', ', day(o_orderdate), '.', month(o_orderdate), '.', year(o_orderdate))"
ACT = "concat('Regulation (EU) ', year(o_orderdate) + 15, '/', o_orderkey % 2000 + 1)"
TEXT = f"concat('In Case ', {CASE}, ' see ', {JOURNAL}, ' and ', {COURT}, ' on ', {ACT}, ', then ', {CASE}, '.')"
DOCS = f"SELECT o_orderkey AS doc_id, {TEXT} AS text FROM orders"

ARTICLES = "concat('articles ', o_custkey % 7 + 1, ', ', o_custkey % 7 + 2, ' and ', o_custkey % 7 + 3, ' of Directive (EU) 2015/', o_orderkey % 900 + 1)"
