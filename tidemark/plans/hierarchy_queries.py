"""Queries over types, fields and methods: method sets, implemented interfaces, calls through interfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hierarchy as hi
from tidemark.plans.registry import query
from tidemark.sources.store import stored

#: A type embeds others of smaller keys, so the SQL ends; cycles are tested with small tables.
_FIELDS = """SELECT concat('T', p_partkey) AS type, concat('T', p_partkey // 3) AS name, concat('T', p_partkey // 3) AS target, p_partkey % 2 = 0 AS pointer FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0
UNION ALL SELECT concat('T', p_partkey), concat('T', p_partkey // 5), concat('T', p_partkey // 5), p_size % 2 = 0 FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 0
UNION ALL SELECT concat('T', p_partkey), concat('I', p_partkey // 9), concat('I', p_partkey // 9), false FROM part WHERE p_partkey % 9 = 4
UNION ALL SELECT concat('T', p_partkey), concat('B', p_partkey % 7), NULL, false FROM part WHERE p_partkey % 4 = 1"""
_METHODS = """SELECT concat('T', p_partkey) AS type, concat('A', p_size % 7) AS method, CASE WHEN p_size % 5 = 0 THEN 'func(int)' ELSE 'func()' END AS signature, p_size % 3 = 0 AS pointer, concat('m', p_partkey % 40, '.go') AS file FROM part
UNION ALL SELECT concat('T', p_partkey), concat('B', p_partkey % 11), 'func()', p_partkey % 4 = 0, concat('m', p_partkey % 40, '.go') FROM part"""
_ABSTRACT = """SELECT concat('I', s_suppkey) AS type, concat('A', s_suppkey % 7) AS method, 'func()' AS signature FROM supplier
UNION ALL SELECT concat('I', s_suppkey), concat('B', s_nationkey % 11), 'func()' FROM supplier WHERE s_suppkey % 2 = 0"""
_EXTENDS = "SELECT concat('I', s_suppkey) AS type, concat('I', s_suppkey // 3) AS target FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 0"


def _relations(p, s):
    """types, fields, methods, embedded interfaces and their methods."""
    of = lambda df, text: df.sparkSession.sql(text.replace("//", "DIV").replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}"), **({"part": p} if "FROM part" in text else {}), **({"supplier": s} if "FROM supplier" in text else {}))
    return p.select(F.concat(F.lit("T"), "p_partkey").alias("type")), of(p, _FIELDS), of(p, _METHODS), of(s, _EXTENDS), of(s, _ABSTRACT)


_SQL = f"""WITH RECURSIVE f AS ({_FIELDS}), m AS ({_METHODS}), a AS ({_ABSTRACT}), x AS ({_EXTENDS}),
ic AS (SELECT DISTINCT type, type AS holder FROM (SELECT type FROM a UNION SELECT type FROM x) UNION SELECT ic.type, x.target FROM ic JOIN x ON x.type = ic.holder),
r AS (SELECT DISTINCT ic.type AS interface, a.method, a.signature FROM ic JOIN a ON a.type = ic.holder),
c AS (SELECT concat('T', p_partkey) AS type, concat('T', p_partkey) AS holder, 0 AS depth, false AS indirect FROM part UNION ALL SELECT c.type, f.target, c.depth + 1, c.indirect OR f.pointer FROM c JOIN f ON f.type = c.holder AND f.target IS NOT NULL),
d AS (SELECT type AS holder, method AS name, signature, pointer, file, true AS is_method FROM m UNION ALL SELECT interface, method, signature, false, NULL, true FROM r UNION ALL SELECT type, name, NULL, false, NULL, false FROM f),
k AS (SELECT c.type, d.name, c.depth, c.indirect, c.holder, d.* EXCLUDE (holder, name), min(c.depth) OVER (PARTITION BY c.type, d.name) AS least FROM c JOIN d USING (holder)),
u AS (SELECT type, name FROM k WHERE depth = least GROUP BY type, name HAVING count(*) = 1),
ms AS (SELECT k.type, k.name AS method, k.signature, k.holder, k.file, NOT k.pointer OR k.indirect AS of_value FROM k JOIN u USING (type, name) WHERE k.depth = k.least AND k.is_method),
im AS (SELECT ms.type, r.interface, bool_and(ms.of_value) AS of_value FROM ms JOIN r USING (method, signature) GROUP BY ms.type, r.interface HAVING count(*) = (SELECT count(*) FROM r AS q WHERE q.interface = r.interface))"""


@query("s30_method_sets", _SQL + " SELECT * FROM ms", "t:part", "t:supplier")
def _(p, s):
    types, fields, methods, extends, abstract = _relations(p, s)
    return hi.method_sets(types, fields, methods, hi.interface_methods(extends, abstract))


@query("s30_interface_methods", _SQL + " SELECT * FROM r", "t:part", "t:supplier")
def _(p, s):
    *_, extends, abstract = _relations(p, s)
    return hi.interface_methods(extends, abstract)


@query("s30_implements", _SQL + " SELECT * FROM im", "t:part", "t:supplier")
def _(p, s):
    types, fields, methods, extends, abstract = _relations(p, s)
    required = hi.interface_methods(extends, abstract)
    return hi.implements(stored(hi.method_sets(types, fields, methods, required), "methods"), required)


_SITES = "SELECT DISTINCT concat('c', p_partkey % 300) AS caller, concat('I', p_partkey % 10 + 1) AS interface, concat('A', p_size % 7) AS method FROM part"


@query(
    "s30_dispatch",
    _SQL + f" SELECT s.caller, concat(coalesce(ms.file, ''), ':', ms.type, '.', ms.method) AS callee, true AS is_virtual FROM ({_SITES}) s JOIN im USING (interface) JOIN ms ON ms.type = im.type AND ms.method = s.method",
    "t:part",
    "t:supplier",
)
def _(p, s):
    types, fields, methods, extends, abstract = _relations(p, s)
    required = hi.interface_methods(extends, abstract)
    sets = stored(hi.method_sets(types, fields, methods, required), "methods")
    sites = p.select(F.expr("concat('c', p_partkey % 300)").alias("caller"), F.expr("concat('I', p_partkey % 10 + 1)").alias("interface"), F.expr("concat('A', p_size % 7)").alias("method")).distinct()
    return hi.dispatch(sites, sets, hi.implements(sets, required.join(sites.select("interface").distinct(), "interface", "left_semi")))
