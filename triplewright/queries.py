"""Named queries over the driver tables, one or more per operator. Each takes (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import job
from . import vocab as v
from .functions import terms
from .operators import rules, sameas, sets
from .operators.closure import transitive_closure
from .operators.hierarchy import Hierarchy, close_hierarchy
from .plans import axioms as ax
from .plans import rulebook as rb
from .plans.materialize import Result, materialize
from .plans.workspace import Workspace
from .settings import Settings
from .sources.lift import lift
from .sources.ntriples import read_triples, reject_lines, stage_lines
from .sources.sinks import schema_triples, to_lines, write_result

CLASS_PARTS = ("item_model", "model_line", "line_type", "line_brand", "type_product", "brand_product",
               "item_sku", "sku_code", "code_sku")
PROPERTY_PARTS = ("supplied_nation", "supplied_any", "supplied_related", "contains_related", "via_route",
                  "route_lane", "lane_route")
# Chains of two locatedIn, so that the rules need one round and a second one to see that it was the last.
JOB_PARTS = ("nation_region", "customer_nation", "supplier_nation", "located_transitive", "placed_by", "placed_inverse",
             "placed_domain", "placed_range", "part_type", "item_sku", "sku_code", "code_sku", "labelled")
BRAND_PARTS = ("brand_on", "brand_value", "line_brand")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ruled(table: DataFrame) -> tuple[DataFrame, bool]:
    """A rule table, written once, and whether it may be broadcast, from its measured size."""
    spark = table.sparkSession
    settings = Settings.of(spark)
    table = Workspace(spark).save(table, "rules")
    width = "coalesce(octet_length(k1), 0) + coalesce(octet_length(k2), 0) + coalesce(octet_length(ho), 0)"
    n, nbytes = table.selectExpr("count(*)", f"coalesce(sum({width}), 0)").first()
    return table, n <= settings.broadcast_rows and nbytes <= settings.broadcast_bytes


def _axioms(spark: SparkSession, folder: str, parts=None) -> DataFrame:
    """The schema statements, selected in one pass over the parts and written once."""
    return Workspace(spark).save(ax.select_axioms(lift(spark, folder, parts)), "axioms")


def _spo(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o").distinct()


def _new(found: DataFrame, facts: DataFrame) -> DataFrame:
    return sets.difference(found.select("s", "p", "o"), facts.select("s", "p", "o"))


# Sources and sinks

def parse_roundtrip(spark, folder):
    """Facts rendered as lines, with the whole document texts as literals, written, read and parsed back."""
    texts = _table(spark, folder, "documents").select(
        F.concat(F.lit("<urn:doc/"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"),
        F.lit("<urn:text>").alias("p"), terms.literal(F.col("text")).alias("o"))
    facts = lift(spark, folder, ("placed_by", "priority", "content_hash"))
    path = f"{Workspace(spark).root}/lines"
    to_lines(facts.unionByName(texts)).write.text(path)
    triples, _ = read_triples(spark, path)
    return triples


def parse_rejects(spark, folder):
    lines = _table(spark, folder, "conversations").select(F.explode(F.split("text", "\n")).alias("value"))
    return reject_lines(lines)


def _term_lines(spark, folder) -> str:
    """A folder of lines with every kind of term, most of them without a space where none is needed."""
    doc, number = "concat('<urn:doc/', doc_id, '>')", "cast(doc_id as string)"
    kinds = (
        f"""concat({doc}, ' <urn:title> "d', {number}, '"@', coalesce(lang, 'en'), ' .')""",
        f"""concat({doc}, '\\t<urn:size>\\t"', coalesce(n_chars, 0), '"^^<urn:int>. # size')""",
        f"concat('_:d', {number}, ' <urn:names> ', {doc}, '.')", f"concat({doc}, '<urn:node>_:d', {number}, '.')",
        f"concat({doc}, ' <urn:node> _:d.', {number}, '.x .')", f"concat('# ', {doc})", "''",
    )
    lines = _table(spark, folder, "documents").selectExpr(f"explode(array({', '.join(kinds)})) as value")
    path = f"{Workspace(spark).root}/lines"
    lines.write.text(path)
    return path


def parse_terms(spark, folder):
    """Language tags, datatypes, blank nodes before a full stop, tabs and comments, read from text."""
    return read_triples(spark, _term_lines(spark, folder))[0]


def parse_lexical(spark, folder):
    """The same lines with literals cut to their quoted part."""
    return read_triples(spark, _term_lines(spark, folder), lexical_only=True)[0]


def new_schema(spark, folder):
    """The closed hierarchies beyond what is stated, written as text and read back."""
    ws = Workspace(spark)
    stated = _axioms(spark, folder, CLASS_PARTS)
    book = rb.compile_rules(ws, stated, Settings.of(spark))
    to_lines(schema_triples(book, stated)).write.text(f"{ws.root}/new_schema")
    return read_triples(spark, f"{ws.root}/new_schema")[0]


def roundtrip_results(spark, folder):
    """The three output folders of a run, written as text and read back. A class has an IRI and two literals."""
    named = _table(spark, folder, "region").selectExpr("concat('<urn:region/', r_regionkey, '>') as s",
        "'<urn:called>' as p", """explode(array(concat('<urn:name/', r_regionkey, '>'), concat('"', r_name, '"'),
        concat('"', lower(r_name), '"'))) as o""")
    stated = spark.createDataFrame([("<urn:called>", v.TYPE, v.FUNCTIONAL)], "s string, p string, o string")
    result = materialize(sets.union_all([
        lift(spark, folder, ("content_hash", "content_inverse", "labelled", "placed_by", "placed_inverse",
                             "placed_domain", "placed_range")), named, stated]), stage=True)
    path = f"{result.workspace.root}/output"
    write_result(result, path)
    triples, _ = read_triples(spark, f"{path}/new_*")
    return triples


def staged_terms(spark, folder):
    """The triples of the lines with every kind of term, from the one pass that also writes the rejects."""
    return stage_lines(spark.read.text(_term_lines(spark, folder)), Workspace(spark))[0]


def staged_rejects(spark, folder):
    """The rejects of that pass over lines of conversations among lines of triples."""
    lines = _table(spark, folder, "conversations").select(F.explode(F.split("text", "\n")).alias("value"))
    return stage_lines(lines.unionByName(to_lines(lift(spark, folder, ("placed_by",)))), Workspace(spark))[1]


def job_report(spark, folder):
    """What the command-line job reports of a run over text, but for the seconds."""
    ws = Workspace(spark)
    lines = to_lines(lift(spark, folder, JOB_PARTS)).unionByName(
        _table(spark, folder, "conversations").select(F.explode(F.split("text", "\n")).alias("value")))
    lines.write.text(f"{ws.root}/lines")
    job.run(spark, [f"{ws.root}/lines", f"{ws.root}/output", "--schema"])
    return spark.read.parquet(f"{ws.root}/output/run_report").where("name <> 'seconds'")


# Axioms

def axiom_pairs(spark, folder):
    """Every schema statement of the whole graph, with the selector that finds it."""
    found = _axioms(spark, folder)
    frames = [ax.axiom(found, p).select("s", F.lit(p).alias("p"), "o") for p in v.AXIOM_PREDICATES]
    frames += [ax.property_set(found, c).select(F.col("p").alias("s"), F.lit(v.TYPE).alias("p"), F.lit(c).alias("o"))
               for c in v.PROPERTY_CLASSES]
    return sets.union_all(frames)


def inverse_index(spark, folder):
    return ax.inverse_pairs(_axioms(spark, folder, ("placed_inverse", "supplies_inverse")))


def restriction_index(spark, folder):
    return ax.restrictions(_axioms(spark, folder, (
        "priority_on", "priority_value", "brand_on", "brand_value", "type_on", "type_some", "rush_on", "rush_all")))


# Hierarchies

def _hierarchy(spark, folder, parts, sub, equivalent) -> tuple[DataFrame, Hierarchy]:
    triples = _axioms(spark, folder, parts)
    edges = ax.hierarchy(triples, sub, equivalent)
    return triples, close_hierarchy(Workspace(spark), edges, settings=Settings.of(spark))


def subclass_closure(spark, folder):
    return _hierarchy(spark, folder, CLASS_PARTS, v.SUBCLASS_OF, v.EQUIVALENT_CLASS)[1].pairs().toDF("s", "o")


def subproperty_closure(spark, folder):
    return _hierarchy(spark, folder, PROPERTY_PARTS, v.SUBPROPERTY_OF, v.EQUIVALENT_PROPERTY)[1].pairs().toDF("s", "o")


def equivalent_classes(spark, folder):
    triples, closed = _hierarchy(spark, folder, CLASS_PARTS, v.SUBCLASS_OF, v.EQUIVALENT_CLASS)
    return ax.new_equivalents(closed.equivalents(), ax.axiom(triples, v.EQUIVALENT_CLASS))


def equivalent_properties(spark, folder):
    triples, closed = _hierarchy(spark, folder, PROPERTY_PARTS, v.SUBPROPERTY_OF, v.EQUIVALENT_PROPERTY)
    return ax.new_equivalents(closed.equivalents(), ax.axiom(triples, v.EQUIVALENT_PROPERTY))


# Instance rules

def _property_rule(spark, folder, facts, table):
    held = lift(spark, folder, facts)
    return _spo(rules.by_property(held, *_ruled(table), Settings.of(spark)))


def subproperty_inherit(spark, folder):
    closed = _hierarchy(spark, folder, PROPERTY_PARTS, v.SUBPROPERTY_OF, v.EQUIVALENT_PROPERTY)[1].pairs()
    return _property_rule(spark, folder, ("contains", "supplied"), rb.property_moves(closed.toDF("p", "q"), "keep"))


def inverse_fwd(spark, folder):
    pairs = ax.axiom(lift(spark, folder, ("placed_inverse",)), v.INVERSE_OF).toDF("p", "q")
    return _property_rule(spark, folder, ("placed_by",), rb.property_moves(pairs, "swap"))


def inverse_bwd(spark, folder):
    pairs = ax.axiom(lift(spark, folder, ("supplies_inverse",)), v.INVERSE_OF).toDF("q", "p")
    return _property_rule(spark, folder, ("supplied",), rb.property_moves(pairs, "swap"))


def symmetric(spark, folder):
    props = ax.property_set(lift(spark, folder, ("adjacent_symmetric",)), v.SYMMETRIC)
    found = _property_rule(spark, folder, ("adjacent",), rb.property_moves(props.selectExpr("p", "p as q"), "swap"))
    return _new(found, lift(spark, folder, ("adjacent",)))


def transitive_located(spark, folder):
    facts = lift(spark, folder, ("nation_region", "customer_nation", "supplier_nation"))
    settings = Settings.of(spark)
    table, small = _ruled(rb.property_rows(
        ax.property_set(_axioms(spark, folder, ("located_transitive",)), v.TRANSITIVE), "transitive"))
    edges = rules.of_keys(facts, "p", table.select("k1"), small, settings)
    closed = transitive_closure(Workspace(spark), edges.selectExpr("p", "s as src", "o as dst"), ["p"], settings)
    return _new(closed.selectExpr("src as s", "p", "dst as o"), facts)


def has_value_triple(spark, folder):
    """Classes that demand a value give it to their members; members by the part's product line."""
    settings = Settings.of(spark)
    schema = _axioms(spark, folder, ("item_model", "model_line", *BRAND_PARTS))
    edges = ax.hierarchy(schema, v.SUBCLASS_OF, v.EQUIVALENT_CLASS)
    closed = close_hierarchy(Workspace(spark), edges, settings=settings).pairs()
    below = rb.class_types(closed.toDF("cls", "sup"))
    types = rules.by_class(lift(spark, folder, ("part_type",)), *_ruled(below), settings)
    values = rb.class_values(ax.restrictions(schema).where("kind = 'hasValue'"))
    return _spo(rules.by_class(types, *_ruled(values), settings))


def has_value_type(spark, folder):
    table = rb.value_types(ax.restrictions(_axioms(spark, folder, ("priority_on", "priority_value"))))
    return _spo(rules.by_value(lift(spark, folder, ("priority",)), *_ruled(table), Settings.of(spark)))


# Type rules

def some_values(spark, folder):
    settings = Settings.of(spark)
    schema = _axioms(spark, folder, (*CLASS_PARTS, "type_on", "type_some"))
    edges = ax.hierarchy(schema, v.SUBCLASS_OF, v.EQUIVALENT_CLASS)
    closed = close_hierarchy(Workspace(spark), edges, settings=settings).pairs()
    below = rb.class_types(closed.toDF("cls", "sup"))
    types = rules.by_class(lift(spark, folder, ("part_type",)), *_ruled(below), settings)
    table, small = _ruled(rb.some_rows(ax.restrictions(schema)))
    facts = rules.of_keys(lift(spark, folder, ("contains",)), "p", table.select("k1"), small, settings)
    return _spo(rules.some_values(facts, types, table, small, settings))


def all_values(spark, folder):
    settings = Settings.of(spark)
    schema = _axioms(spark, folder, ("priority_on", "priority_value", "rush_on", "rush_all", "orders_rush"))
    restriction = ax.restrictions(schema)
    values = rb.value_types(restriction.where("kind = 'hasValue'"))
    orders = rules.by_value(lift(spark, folder, ("priority",)), *_ruled(values), settings)
    above = rb.class_types(ax.axiom(schema, v.SUBCLASS_OF).toDF("cls", "sup"))
    rushed = rules.by_class(orders, *_ruled(above), settings)
    table, small = _ruled(rb.all_rows(restriction.where("kind = 'all'")))
    facts = rules.of_keys(lift(spark, folder, ("contains",)), "p", table.select("k2"), small, settings)
    return _spo(rules.all_values(facts, rushed, table, small, settings))


def domain_types(spark, folder):
    pairs = ax.axiom(lift(spark, folder, ("placed_domain",)), v.DOMAIN).toDF("p", "cls")
    return _property_rule(spark, folder, ("placed_by",), rb.property_types(pairs, "subject"))


def range_types(spark, folder):
    pairs = ax.axiom(lift(spark, folder, ("placed_range",)), v.RANGE).toDF("p", "cls")
    return _property_rule(spark, folder, ("placed_by",), rb.property_types(pairs, "object"))


def subclass_types(spark, folder):
    closed = _hierarchy(spark, folder, CLASS_PARTS, v.SUBCLASS_OF, v.EQUIVALENT_CLASS)[1].pairs()
    table = rb.class_types(closed.toDF("cls", "sup"))
    return _spo(rules.by_class(lift(spark, folder, ("part_type",)), *_ruled(table), Settings.of(spark)))


# sameAs

def _held(spark, folder, facts: DataFrame, axioms: tuple[str, ...], characteristic: str, rule: str) -> DataFrame:
    """The facts whose property the axioms declare to be of the class ``characteristic``, written once."""
    keys = ax.property_set(_axioms(spark, folder, axioms), characteristic)
    table, small = _ruled(rb.property_rows(keys, rule))
    return Workspace(spark).save(rules.of_keys(facts, "p", table.select("k1"), small, Settings.of(spark)), "held")


def _functional(spark, folder, facts):
    held = _held(spark, folder, facts, ("hash_functional",), v.FUNCTIONAL, "functional")
    return sameas.functional_links(held, Settings.of(spark), held.count())


def _inverse_functional(spark, folder, facts):
    held = _held(spark, folder, facts, ("content_inverse",), v.INVERSE_FUNCTIONAL, "inverse_functional")
    return sameas.inverse_functional_links(held, Settings.of(spark), held.count())


def functional_sameas(spark, folder):
    return _functional(spark, folder, lift(spark, folder, ("hash_of",)))


def inverse_functional_sameas(spark, folder):
    return _inverse_functional(spark, folder, lift(spark, folder, ("content_hash",)))


SAME_PARTS = ("content_hash", "content_inverse", "hash_of", "hash_functional", "labelled")


def _same(spark, folder) -> tuple[DataFrame, DataFrame]:
    facts = lift(spark, folder, SAME_PARTS)
    asserted = ax.sameas_of(facts)
    links = sets.union_all([asserted, _functional(spark, folder, facts), _inverse_functional(spark, folder, facts)])
    return sameas.sameas_classes(Workspace(spark), links, Settings.of(spark)), asserted


def sameas_closure(spark, folder):
    return _same(spark, folder)[0]


def sameas_counts(spark, folder):
    return sameas.pair_counts(*_same(spark, folder))


def sameas_pairs(spark, folder):
    """Every ordered pair of equal nodes that is not stated."""
    return sameas.new_pairs(*_same(spark, folder), Settings.of(spark))


# The whole fixpoint

def _run(spark, folder) -> Result:
    return materialize(lift(spark, folder), stage=True)


def new_instances(spark, folder):
    return _run(spark, folder).new_instances


def new_types(spark, folder):
    return _run(spark, folder).new_types


def new_sameas(spark, folder):
    return _run(spark, folder).new_sameas


def run_report(spark, folder):
    return _run(spark, folder).metrics()


def round_rows(spark, folder):
    """What each round found, of a run that needs two."""
    return materialize(lift(spark, folder, JOB_PARTS), stage=True).round_rows()


# Set operators, grouping and counting

def union_triples(spark, folder):
    return sets.union_all([lift(spark, folder, (n,)) for n in ("placed_by", "priority", "contains")])


def difference_triples(spark, folder):
    every = lift(spark, folder, ("contains",)).select("s", "o")
    shipped = _table(spark, folder, "lineitem").where("l_linestatus = 'O'").selectExpr(
        "'<urn:order/' || cast(l_orderkey as string) || '>' as s",
        "'<urn:part/' || cast(l_partkey as string) || '>' as o")
    return sets.difference(every, shipped)


def distinct_triples(spark, folder):
    return lift(spark, folder, ("contains", "part_type", "placed_by")).distinct()


def group_values(spark, folder):
    facts = lift(spark, folder, ("placed_by", "customer_nation", "content_hash"))
    grouped = sets.group_values(facts.selectExpr("o as k", "s as val"), "k", "val", per_chunk=20)
    return grouped.select("k", "chunk", "n", F.array_join("vals", " ").alias("vals"))


def count_by_predicate(spark, folder):
    return lift(spark, folder).groupBy("p").agg(F.count("*").alias("n"))


def type_rows(spark, folder):
    return ax.types_of(lift(spark, folder))


def sameas_rows(spark, folder):
    return ax.sameas_of(lift(spark, folder))


QUERIES = {f.__name__: f for f in (
    parse_roundtrip, parse_rejects, parse_terms, parse_lexical, staged_terms, staged_rejects, job_report, roundtrip_results, new_schema, type_rows, sameas_rows,
    axiom_pairs, inverse_index, restriction_index,
    subclass_closure, subproperty_closure, equivalent_classes, equivalent_properties,
    subproperty_inherit, inverse_fwd, inverse_bwd, symmetric, transitive_located, has_value_triple,
    has_value_type, some_values, all_values, domain_types, range_types, subclass_types,
    functional_sameas, inverse_functional_sameas, sameas_closure, sameas_counts, sameas_pairs,
    new_instances, new_types, new_sameas, run_report, round_rows,
    union_triples, difference_triples, distinct_triples, group_values, count_by_predicate,
)}
