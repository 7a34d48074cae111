"""Registered queries: every operator run over the given tables, with an independent SQL check.

The tables are not clinical. Orders stand for visits, customers for patients, order totals
for a measure and regions for sites; the mapping exercises the operators and means nothing
else. Each module holds ``QUERIES`` and ``SQL`` under the same names.
"""

from cohortlens.catalog import evaluation, labels, models, outputs, survival, tables, timeline

MODULES = (tables, timeline, labels, survival, models, evaluation, outputs)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
