"""Driver tables as RDF triples: facts and a schema, all derived from the rows of the tables.

Each part is an SQL query over the table views that Spark and DuckDB read alike, so the same text feeds the
engine and the oracles. ``facts`` parts are instance rows, ``schema`` parts are axioms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import vocab as v

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels",
          "conversations")


def iri(kind: str, key: str) -> str:
    """SQL for <urn:kind/key>."""
    return f"'<urn:{kind}/' || {key} || '>'"


def name(term: str) -> str:
    return f"'<urn:{term}>'"


def triple(s: str, p: str, o: str) -> str:
    return f"{s} as s, {p} as p, {o} as o"


def quoted(term: str) -> str:
    return f"'{term}'"


ORDER = iri("order", "cast({} as varchar(20))")
PART = iri("part", "cast({} as varchar(20))")
DOC = iri("doc", "cast({} as varchar(20))")


def _key(kind: str, column: str) -> str:
    return iri(kind, f"cast({column} as varchar(20))")


MODEL = iri("model", "replace(p_brand, '#', '') || '/' || p_type || '/' || cast(p_size as varchar(20))")
LINE = iri("line", "replace(p_brand, '#', '') || '/' || p_type")
BRAND = iri("brand", "replace(p_brand, '#', '')")
PTYPE = iri("ptype", "p_type")
TURN = "'<urn:turn/' || cast(conv_id as varchar(20)) || '/' || cast({} as varchar(20)) || '>'"
TYPE, SUB, SUBP = quoted(v.TYPE), quoted(v.SUBCLASS_OF), quoted(v.SUBPROPERTY_OF)
ON, EQC, EQP = quoted(v.ON_PROPERTY), quoted(v.EQUIVALENT_CLASS), quoted(v.EQUIVALENT_PROPERTY)

FACTS = {
    "nation_region": f"select {triple(_key('nation', 'n_nationkey'), name('locatedIn'), _key('region', 'n_regionkey'))} from nation",
    "customer_nation": f"select {triple(_key('customer', 'c_custkey'), name('locatedIn'), _key('nation', 'c_nationkey'))} from customer",
    "supplier_nation": f"select {triple(_key('supplier', 's_suppkey'), name('locatedIn'), _key('nation', 's_nationkey'))} from supplier",
    "adjacent": f"select {triple(TURN.format('turn - 1'), name('adjacentTo'), TURN.format('turn'))} from conversations where turn > 0",
    "placed_by": f"select {triple(_key('order', 'o_orderkey'), name('placedBy'), _key('customer', 'o_custkey'))} from orders",
    "contains": f"select {triple(_key('order', 'l_orderkey'), name('contains'), _key('part', 'l_partkey'))} from lineitem",
    "supplied": f"select {triple(_key('order', 'l_orderkey'), _key('suppliedBy', 'l_suppkey'), _key('part', 'l_partkey'))} from lineitem",
    "priority": f"""select {triple(_key('order', 'o_orderkey'), name('priority'), "'\"' || o_orderpriority || '\"'")} from orders""",
    "part_type": f"select {triple(_key('part', 'p_partkey'), TYPE, _key('item', 'p_partkey'))} from part",
    "content_hash": f"""select {triple(_key('doc', 'doc_id'), name('contentHash'), "'\"' || md5(text) || '\"'")} from documents""",
    "hash_of": f"select {triple(iri('hash', 'md5(text)'), name('hashOf'), _key('doc', 'doc_id'))} from documents",
    "labelled": f"select {triple(_key('doc', 'doc_id'), quoted(v.SAME_AS), _key('labelled', 'doc_id'))} from labels",
}

SCHEMA = {
    # Classes: item <= model <= line <= ptype, brand <= Product; item = sku, sku <= code <= sku.
    "item_model": f"select {triple(_key('item', 'p_partkey'), SUB, MODEL)} from part",
    "model_line": f"select distinct {triple(MODEL, SUB, LINE)} from part",
    "line_type": f"select distinct {triple(LINE, SUB, PTYPE)} from part",
    "line_brand": f"select distinct {triple(LINE, SUB, BRAND)} from part",
    "type_product": f"select distinct {triple(PTYPE, SUB, name('Product'))} from part",
    "brand_product": f"select distinct {triple(BRAND, SUB, name('Product'))} from part",
    "item_sku": f"select {triple(_key('item', 'p_partkey'), EQC, _key('sku', 'p_partkey'))} from part",
    "sku_code": f"select {triple(_key('sku', 'p_partkey'), SUB, _key('code', 'p_partkey'))} from part",
    "code_sku": f"select {triple(_key('code', 'p_partkey'), SUB, _key('sku', 'p_partkey'))} from part",
    # Properties: suppliedBy/k <= suppliedBy/nation/n <= suppliedBy <= relatedTo; via = route, route <= lane <= route.
    "supplied_nation": f"select {triple(_key('suppliedBy', 's_suppkey'), SUBP, _key('suppliedBy/nation', 's_nationkey'))} from supplier",
    "supplied_any": f"select distinct {triple(_key('suppliedBy/nation', 's_nationkey'), SUBP, name('suppliedBy'))} from supplier",
    "supplied_related": f"select distinct {triple(name('suppliedBy'), SUBP, name('relatedTo'))} from supplier",
    "contains_related": f"select distinct {triple(name('contains'), SUBP, name('relatedTo'))} from part",
    "via_route": f"select {triple(_key('via', 's_suppkey'), EQP, _key('route', 's_suppkey'))} from supplier",
    "route_lane": f"select {triple(_key('route', 's_suppkey'), SUBP, _key('lane', 's_suppkey'))} from supplier",
    "lane_route": f"select {triple(_key('lane', 's_suppkey'), SUBP, _key('route', 's_suppkey'))} from supplier",
    "made_attribute": f"select distinct {triple(name('madeBy'), SUBP, name('attribute'))} from part",
    # Property characteristics.
    "located_transitive": f"select distinct {triple(name('locatedIn'), TYPE, quoted(v.TRANSITIVE))} from nation",
    "adjacent_symmetric": f"select distinct {triple(name('adjacentTo'), TYPE, quoted(v.SYMMETRIC))} from conversations",
    "hash_functional": f"select distinct {triple(name('hashOf'), TYPE, quoted(v.FUNCTIONAL))} from documents",
    "content_inverse": f"select distinct {triple(name('contentHash'), TYPE, quoted(v.INVERSE_FUNCTIONAL))} from documents",
    "placed_inverse": f"select distinct {triple(name('placedBy'), quoted(v.INVERSE_OF), name('placed'))} from orders",
    "supplies_inverse": f"select {triple(_key('supplies', 's_suppkey'), quoted(v.INVERSE_OF), _key('suppliedBy', 's_suppkey'))} from supplier",
    "placed_domain": f"select distinct {triple(name('placedBy'), quoted(v.DOMAIN), name('Order'))} from orders",
    "placed_range": f"select distinct {triple(name('placedBy'), quoted(v.RANGE), name('Customer'))} from orders",
    "attribute_domain": f"select distinct {triple(name('attribute'), quoted(v.DOMAIN), name('Described'))} from part",
    # Restrictions: orders/P hasValue "P" on priority; brand/B hasValue "B" on madeBy;
    # ordersOf/T some ptype/T on contains; rush/P all partsOf/P on contains, orders/P <= rush/P.
    "priority_on": f"select distinct {triple(iri('orders', 'o_orderpriority'), ON, name('priority'))} from orders",
    "priority_value": f"""select distinct {triple(iri('orders', 'o_orderpriority'), quoted(v.HAS_VALUE), "'\"' || o_orderpriority || '\"'")} from orders""",
    "brand_on": f"select distinct {triple(BRAND, ON, name('madeBy'))} from part",
    "brand_value": f"""select distinct {triple(BRAND, quoted(v.HAS_VALUE), "'\"' || p_brand || '\"'")} from part""",
    "type_on": f"select distinct {triple(iri('ordersOf', 'p_type'), ON, name('contains'))} from part",
    "type_some": f"select distinct {triple(iri('ordersOf', 'p_type'), quoted(v.SOME_VALUES_FROM), PTYPE)} from part",
    "rush_on": f"select distinct {triple(iri('rush', 'o_orderpriority'), ON, name('contains'))} from orders",
    "rush_all": f"select distinct {triple(iri('rush', 'o_orderpriority'), quoted(v.ALL_VALUES_FROM), iri('partsOf', 'o_orderpriority'))} from orders",
    "orders_rush": f"select distinct {triple(iri('orders', 'o_orderpriority'), SUB, iri('rush', 'o_orderpriority'))} from orders",
}

PARTS = {**FACTS, **SCHEMA}


def parts_sql(names) -> str:
    return " union all ".join(PARTS[n] for n in names)


def lift(spark: SparkSession, folder: str, names=None) -> DataFrame:
    """Triples (s, p, o) of the named parts, or of all of them, from the Parquet tables in ``folder``."""
    sql = parts_sql(names or PARTS)
    views = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if f"from {t}" in sql}
    for table in views:
        sql = sql.replace(f"from {table}", f"from {{{table}}}")
    return spark.sql(sql, **views)
