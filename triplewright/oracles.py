"""Standard SQL for the named queries, written from the meaning of the rules and run by DuckDB."""

from __future__ import annotations

from . import vocab as v
from .queries import CLASS_PARTS, JOB_PARTS, PROPERTY_PARTS, SAME_PARTS
from .sources.lift import FACTS, PARTS, parts_sql

CLASS_EDGES = (*CLASS_PARTS, "orders_rush")
PROPERTY_EDGES = (*PROPERTY_PARTS, "made_attribute")


def _facts(*names: str) -> str:
    return f"(select distinct s, p, o from ({parts_sql(names)}))"


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


def _closure(name: str, parts, equivalent: str) -> str:
    """CTEs <name>_edges and <name>(src, dst), the closure of a hierarchy without equal ends."""
    return f"""{name}_axioms as (select distinct s, p, o from ({parts_sql(parts)})),
{name}_edges as (
  select s as src, o as dst from {name}_axioms
  union select o, s from {name}_axioms where p = '{equivalent}'),
{name} as (
  select src, dst from {name}_edges where src <> dst
  union
  select t.src, e.dst from {name} t join {name}_edges e on t.dst = e.src where t.src <> e.dst)"""


def _mutual(name: str, equivalent: str) -> str:
    return f"""select a.src as s, a.dst as o from {name} a join {name} b on a.src = b.dst and a.dst = b.src
where not exists (select 1 from {name}_axioms x where x.p = '{equivalent}'
                  and ((x.s = a.src and x.o = a.dst) or (x.s = a.dst and x.o = a.src)))"""


CLASSES = _closure("sub", CLASS_PARTS, v.EQUIVALENT_CLASS)
ALL_CLASSES = _closure("sub", CLASS_EDGES, v.EQUIVALENT_CLASS)
PROPERTIES = _closure("subp", PROPERTY_PARTS, v.EQUIVALENT_PROPERTY)
ALL_PROPERTIES = _closure("subp", PROPERTY_EDGES, v.EQUIVALENT_PROPERTY)

RESTRICTIONS = f"""graph as (select distinct s, p, o from ({parts_sql(PARTS)})),
restriction as (
  select case f.p when '{v.HAS_VALUE}' then 'hasValue' when '{v.SOME_VALUES_FROM}' then 'some' else 'all' end as kind,
         f.s as cls, n.o as prop, f.o as filler
  from graph f join graph n on f.s = n.s and n.p = '{v.ON_PROPERTY}'
  where f.p in ('{v.HAS_VALUE}', '{v.SOME_VALUES_FROM}', '{v.ALL_VALUES_FROM}'))"""

LOCATED = f"""located as (select distinct s, o from ({parts_sql(("nation_region", "customer_nation", "supplier_nation"))})),
reach as (select s, o from located union select r.s, l.o from reach r join located l on r.o = l.s where r.s <> l.o)"""

PART_TYPES = f"""part_types as (
  select s, o from ({PARTS["part_type"]})
  union select t.s, c.dst from ({PARTS["part_type"]}) t join sub c on t.o = c.src)"""

# Everything the rules derive, in the order of their dependencies in this graph.
FIXPOINT = ",\n".join([
    ALL_CLASSES, ALL_PROPERTIES, RESTRICTIONS, LOCATED, PART_TYPES,
    f"""order_classes as (
  select f.s, r.cls as o from ({PARTS["priority"]}) f join restriction r on r.kind = 'hasValue' and r.prop = f.p and r.filler = f.o),
all_order_classes as (
  select s, o from order_classes union select t.s, c.dst from order_classes t join sub c on t.o = c.src),
contained as (select distinct s, p, o from ({PARTS["contains"]})),
made as (
  select t.s, r.prop as p, r.filler as o from part_types t
  join restriction r on r.kind = 'hasValue' and r.cls = t.o),
found_types as (
  select s, o from part_types
  union select s, o from all_order_classes
  union select c.s, r.cls from contained c join part_types t on t.s = c.o
        join restriction r on r.kind = 'some' and r.prop = c.p and r.filler = t.o
  union select c.o, r.filler from contained c join all_order_classes t on t.s = c.s
        join restriction r on r.kind = 'all' and r.prop = c.p and r.cls = t.o
  union select s, '<urn:Order>' from ({PARTS["placed_by"]})
  union select o, '<urn:Customer>' from ({PARTS["placed_by"]})
  union select s, '<urn:Described>' from made),
found_instances as (
  select s, p, o from made
  union select s, '<urn:attribute>', o from made
  union select f.s, c.dst, f.o from ({parts_sql(("contains", "supplied"))}) f join subp c on f.p = c.src
  union select o, replace(p, 'suppliedBy', 'supplies'), s from ({PARTS["supplied"]})
  union select o, '<urn:placed>', s from ({PARTS["placed_by"]})
  union select o, p, s from ({PARTS["adjacent"]})
  union select s, '<urn:locatedIn>', o from reach)""",
])

SAME = f"""same_graph as (select distinct s, p, o from ({parts_sql(SAME_PARTS)})),
same_edges as (
  select s as x, o as y from same_graph where p = '{v.SAME_AS}'
  union select s, min(s) over (partition by o) from same_graph where p = '<urn:contentHash>'
  union select o, min(o) over (partition by s) from same_graph where p = '<urn:hashOf>'),
same_both as (select x, y from same_edges where x <> y union select y, x from same_edges where x <> y),
same_reach as (
  select x, y from same_both union select r.x, b.y from same_reach r join same_both b on r.y = b.x),
same_classes as (select x as node, least(min(x), min(y)) as rep from same_reach group by x)"""

SAME_STATED = f"(select distinct s as x, o as y from ({PARTS['labelled']}))"
SAME_COUNTS = f"""(select count(distinct rep) as classes, count(*) as members,
  (select max(n) from (select count(*) as n from same_classes group by rep)) as largest,
  (select count(*) from same_reach where x <> y) as pairs,
  (select count(*) from (select x, y from same_reach where x <> y except select x, y from {SAME_STATED})) as new_pairs
  from same_classes)"""

NEW_TYPES = f"select s, o as cls from found_types except select s, o from graph where p = '{v.TYPE}'"
NEW_INSTANCES = "select s, p, o from found_instances except select s, p, o from graph"

_escaped = "text"
for _char, _code in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'")):
    _escaped = f"replace({_escaped}, {_char}, {_code})"


def _links(parts: str, shared: str, member: str) -> str:
    return f"""select distinct x, y from (
  select {member} as x, min({member}) over (partition by {shared}, p) as y from {_facts(parts)}) where x <> y"""


def _terms(tag: str, datatype: str) -> str:
    return f"""with d as (select '<urn:doc/' || doc_id || '>' as s, doc_id, lang, n_chars from documents)
select s, '<urn:title>' as p, '"d' || doc_id{tag} as o from d
union all select s, '<urn:size>', '"' || coalesce(n_chars, 0){datatype} from d
union all select '_:d' || doc_id, '<urn:names>', s from d
union all select s, '<urn:node>', '_:d' || doc_id from d
union all select s, '<urn:node>', '_:d.' || doc_id || '.x' from d"""


REJECTS = r"""select value, case when regexp_matches(value, '^\s*(<[^<>\s]*>|_:[^\s<>"]+)') then 'no predicate'
  else 'no subject' end as reason
from (select unnest(string_split(text, chr(10))) as value from conversations)
where not regexp_matches(value, '^\s*(#|$)')"""

# What the rules find in JOB_PARTS: paths of two steps, the inverse of placedBy, its ends' types, and for the type
# of each part the two classes that are equal to it.
JOB = f"""located as (select distinct s, o from ({parts_sql(("nation_region", "customer_nation", "supplier_nation"))})),
job_instances as (
  select count(*) as n from (select a.s, b.o from located a join located b on a.o = b.s where a.s <> b.o
    except select s, o from located)
  union all select count(*) from (select distinct s, o from ({PARTS["placed_by"]}))),
job_types as (
  select count(distinct s) as n from ({PARTS["placed_by"]}) union all select count(distinct o) from ({PARTS["placed_by"]})
  union all select 2 * count(distinct s) from ({PARTS["part_type"]})),
job_links as (select count(*) as n from (select distinct s, o from ({PARTS["labelled"]}))),
job_classes as (select 4 * count(*) as n from (select distinct s, o from ({PARTS["item_sku"]}))),
job_sizes as (select (select sum(n) from job_instances) as instances, (select sum(n) from job_types) as types,
  (select n from job_links) as links, (select n from job_classes) as classes)"""

JOB_REPORT = _with(JOB) + f"""select name, cast(value as bigint) as value from (
select 'input_triples' as name, count(*) as value from ({parts_sql(JOB_PARTS)})
union all select 'input_types', count(*) from ({parts_sql(JOB_PARTS)}) where p = '{v.TYPE}'
union all select 'rejected_lines', count(*) from ({REJECTS})
union all select unnest(['new_instances', 'new_instances_written']), instances from job_sizes
union all select unnest(['new_types', 'new_types_written']), types from job_sizes
union all select unnest(['new_sameas_pairs', 'new_sameas_written']), links from job_sizes
union all select 'largest_sameas_class', case when links > 0 then 2 else 0 end from job_sizes
union all select unnest(['new_subclasses', 'new_equivalent_classes', 'new_schema_written']), classes from job_sizes
union all select 'round_1', instances + types from job_sizes
union all select 'rounds', 2
union all select unnest(['round_2', 'new_subproperties', 'new_equivalent_properties', 'new_instances_left_out',
  'new_types_left_out', 'new_sameas_left_out', 'new_schema_left_out']), 0)"""

ORACLES = {
    "parse_roundtrip": f"""{parts_sql(("placed_by", "priority", "content_hash"))}
union all select '<urn:doc/' || cast(doc_id as varchar) || '>', '<urn:text>', '"' || {_escaped} || '"' from documents""",
    "parse_rejects": REJECTS,
    "roundtrip_results": f"""{_with(SAME)}
select o as s, '<urn:placed>' as p, s as o from ({PARTS["placed_by"]})
union select s, '{v.TYPE}', '<urn:Order>' from ({PARTS["placed_by"]})
union select o, '{v.TYPE}', '<urn:Customer>' from ({PARTS["placed_by"]})
union (select node, '{v.SAME_AS}', rep from same_classes where node <> rep
       except select x, '{v.SAME_AS}', y from {SAME_STATED})
union select '<urn:name/' || r_regionkey || '>', '{v.SAME_AS}', '"' || unnest([r_name, lower(r_name)]) || '"' from region""",
    "parse_terms": _terms(""" || '"@' || coalesce(lang, 'en')""", """ || '"^^<urn:int>'"""),
    "parse_lexical": _terms(""" || '"'""", """ || '"'"""),
    "staged_terms": _terms(""" || '"@' || coalesce(lang, 'en')""", """ || '"^^<urn:int>'"""),
    "staged_rejects": REJECTS,
    "job_report": JOB_REPORT,
    "new_schema": _with(CLASSES) + f"""select src as s, '{v.SUBCLASS_OF}' as p, dst as o from sub
where not exists (select 1 from sub_axioms x where x.p = '{v.SUBCLASS_OF}' and x.s = src and x.o = dst)""",
    "type_rows": f"select s, o as cls from ({parts_sql(PARTS)}) where p = '{v.TYPE}'",
    "sameas_rows": f"select x, y from {SAME_STATED}",
    "axiom_pairs": f"""select distinct s, p, o from ({parts_sql(PARTS)})
where p in ({", ".join(f"'{p}'" for p in v.AXIOM_PREDICATES)})
   or (p = '{v.TYPE}' and o in ({", ".join(f"'{c}'" for c in v.PROPERTY_CLASSES)}))""",
    "inverse_index": f"""with g as (select s, o from ({parts_sql(PARTS)}) where p = '{v.INVERSE_OF}')
select s as p, o as q from g union select o, s from g""",
    "restriction_index": _with(RESTRICTIONS) + "select kind, cls, prop, filler from restriction",
    "subclass_closure": _with(CLASSES) + "select src as s, dst as o from sub",
    "subproperty_closure": _with(PROPERTIES) + "select src as s, dst as o from subp",
    "equivalent_classes": _with(CLASSES) + _mutual("sub", v.EQUIVALENT_CLASS),
    "equivalent_properties": _with(PROPERTIES) + _mutual("subp", v.EQUIVALENT_PROPERTY),
    "subproperty_inherit": _with(PROPERTIES) + f"""select distinct f.s, c.dst as p, f.o
from ({parts_sql(("contains", "supplied"))}) f join subp c on f.p = c.src""",
    "inverse_fwd": f"select distinct o as s, '<urn:placed>' as p, s as o from ({PARTS['placed_by']})",
    "inverse_bwd": f"select distinct o as s, replace(p, 'suppliedBy', 'supplies') as p, s as o from ({PARTS['supplied']})",
    "symmetric": f"select o as s, p, s as o from ({PARTS['adjacent']}) except select s, p, o from ({PARTS['adjacent']})",
    "transitive_located": _with(LOCATED) + """select s, '<urn:locatedIn>' as p, o from
(select s, o from reach except select s, o from located)""",
    "has_value_triple": _with(RESTRICTIONS) + f"""select distinct t.s, r.prop as p, r.filler as o
from ({PARTS["part_type"]}) t join graph a on a.s = t.o and a.p = '{v.SUBCLASS_OF}'
join graph b on b.s = a.o and b.p = a.p join graph c on c.s = b.o and c.p = a.p
join restriction r on r.kind = 'hasValue' and r.cls = c.o""",
    "has_value_type": f"""select distinct s, '{v.TYPE}' as p, '<urn:orders/' || replace(o, '"', '') || '>' as o
from ({PARTS["priority"]})""",
    "some_values": _with(CLASSES, RESTRICTIONS, PART_TYPES) + f"""select distinct c.s, '{v.TYPE}' as p, r.cls as o
from ({PARTS["contains"]}) c join part_types t on t.s = c.o
join restriction r on r.kind = 'some' and r.prop = c.p and r.filler = t.o""",
    "all_values": f"""select distinct c.o as s, '{v.TYPE}' as p, '<urn:partsOf/' || replace(u.o, '"', '') || '>' as o
from ({PARTS["contains"]}) c join ({PARTS["priority"]}) u on u.s = c.s""",
    "domain_types": f"select distinct s, '{v.TYPE}' as p, '<urn:Order>' as o from ({PARTS['placed_by']})",
    "range_types": f"select distinct o as s, '{v.TYPE}' as p, '<urn:Customer>' as o from ({PARTS['placed_by']})",
    "subclass_types": _with(CLASSES) + f"""select distinct t.s, '{v.TYPE}' as p, c.dst as o
from ({PARTS["part_type"]}) t join sub c on t.o = c.src""",
    "functional_sameas": _links("hash_of", "s", "o"),
    "inverse_functional_sameas": _links("content_hash", "o", "s"),
    "sameas_closure": _with(SAME) + "select node, rep from same_classes",
    "sameas_counts": _with(SAME) + f"select classes, members, largest, pairs, new_pairs from {SAME_COUNTS}",
    "sameas_pairs": _with(SAME) + f"""select a.node as x, b.node as y
from same_classes a join same_classes b on a.rep = b.rep and a.node <> b.node except select x, y from {SAME_STATED}""",
    "new_instances": _with(FIXPOINT) + NEW_INSTANCES,
    "new_types": _with(FIXPOINT) + NEW_TYPES,
    "new_sameas": _with(SAME) + f"select node as x, rep as y from same_classes where node <> rep except select x, y from {SAME_STATED}",
    "run_report": _with(FIXPOINT, SAME) + f"""select 'input_triples' as name, count(*) as value from ({parts_sql(PARTS)})
union all select 'input_types', count(*) from ({parts_sql(PARTS)}) where p = '{v.TYPE}'
union all select 'new_subclasses', count(*) from (select src, dst from sub except select s, o from graph where p = '{v.SUBCLASS_OF}')
union all select 'new_equivalent_classes', count(*) from ({_mutual("sub", v.EQUIVALENT_CLASS)})
union all select 'new_subproperties', count(*) from (select src, dst from subp except select s, o from graph where p = '{v.SUBPROPERTY_OF}')
union all select 'new_equivalent_properties', count(*) from ({_mutual("subp", v.EQUIVALENT_PROPERTY)})
union all select 'new_instances', count(*) from ({NEW_INSTANCES})
union all select 'new_types', count(*) from ({NEW_TYPES})
union all select 'new_sameas_pairs', new_pairs from {SAME_COUNTS}
union all select 'largest_sameas_class', largest from {SAME_COUNTS}""",
    "round_rows": _with(JOB) + """select cast(round as integer) as round, kind, cast(n as bigint) as rows from (
select 1 as round, 'instance' as kind, instances as n from job_sizes union all select 1, 'type', types from job_sizes
union all select 1, 'sameas', 0 union all select 2, unnest(['instance', 'type', 'sameas']), 0)""",
    "union_triples": parts_sql(("placed_by", "priority", "contains")),
    "difference_triples": f"""select s, o from ({PARTS["contains"]}) except
select '<urn:order/' || cast(l_orderkey as varchar) || '>', '<urn:part/' || cast(l_partkey as varchar) || '>'
from lineitem where l_linestatus = 'O'""",
    "distinct_triples": f"select distinct s, p, o from ({parts_sql(('contains', 'part_type', 'placed_by'))})",
    "group_values": f"""with pairs as (select distinct o as k, s as val from ({parts_sql(("placed_by", "customer_nation", "content_hash"))})),
sizes as (select k, cast(ceil(count(*) / 20.0) as bigint) as chunks from pairs group by k)
select k, cast('0x' || substr(md5(val), 1, 8) as bigint) % chunks as chunk, count(*) as n,
  string_agg(val, ' ' order by val) as vals
from pairs join sizes using (k) group by k, cast('0x' || substr(md5(val), 1, 8) as bigint) % chunks""",
    "count_by_predicate": f"select p, count(*) as n from ({parts_sql(PARTS)}) group by p",
}
