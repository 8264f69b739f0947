"""Compiles the schema of a data set into rule tables that the rules join facts with.

Consequences that follow from the schema alone are worked out here, once, on the small side: chains of
subproperty, inverse and symmetric steps become one row, and domains, ranges and values carry all their
superclasses. A fact then needs one join to get everything its property or class implies, and the loop
over the facts needs fewer rounds.

Rule rows (rule, k1, k2, place, hp, ho, closed):

    property            k1 = p               place says where the terms of s p o go, see below
    class               k1 = class           u type k1 -> u hp ho
    value               k1 = p, k2 = o       u k1 k2 -> u hp ho
    some                k1 = p, k2 = filler  u p x, x type k2 -> u type ho
    all                 k1 = class, k2 = p   u type k1, u k2 x -> x type ho
    transitive, functional, inverse_functional    k1 = p

    place: keep -> s hp o, swap -> o hp s, subject -> s hp ho, object -> o hp ho

``closed`` marks heads u type c whose own class rows are also rows of this key, so they need no second look. Heads of
some and all rows are closed where their class has no class rows.
The rows of a class with very many consequences are not repeated under the very many keys that lead to it: how many
that would be is counted first, and beyond a limit the head stays open and takes the class's rows in the next round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..operators.hierarchy import Hierarchy, close_hierarchy
from ..operators.sets import union_all
from ..settings import Settings
from .axioms import hierarchy, inverse_pairs, property_set, restrictions
from .workspace import Workspace

TYPE = f"'{v.TYPE}'"


def rows(df: DataFrame, rule: str, k1: str, k2: str = "null", place: str = "null", hp: str = "null",
         ho: str = "null", closed: str = "null") -> DataFrame:
    """Rule rows from SQL expressions over ``df``."""
    return df.selectExpr(
        f"'{rule}' as rule", f"{k1} as k1", f"cast({k2} as string) as k2", f"cast({place} as string) as place",
        f"cast({hp} as string) as hp", f"cast({ho} as string) as ho", f"cast({closed} as boolean) as closed")


def property_moves(pairs: DataFrame, place: str) -> DataFrame:
    """Rows for s p o -> s q o (keep) or o q s (swap), from pairs (p, q)."""
    return rows(pairs, "property", "p", place=f"'{place}'", hp="q", closed="false")


def property_types(pairs: DataFrame, place: str) -> DataFrame:
    """Rows for s p o -> s type cls (subject) or o type cls (object), from pairs (p, cls)."""
    return rows(pairs, "property", "p", place=f"'{place}'", hp=TYPE, ho="cls", closed="true")


def class_types(pairs: DataFrame) -> DataFrame:
    """Rows for u type cls -> u type sup, from pairs (cls, sup)."""
    return rows(pairs, "class", "cls", hp=TYPE, ho="sup", closed="true")


def class_values(restriction: DataFrame) -> DataFrame:
    """Rows for u type cls -> u prop filler, from hasValue restrictions."""
    return rows(restriction, "class", "cls", hp="prop", ho="filler", closed="false")


def value_types(restriction: DataFrame) -> DataFrame:
    """Rows for u prop filler -> u type cls, from hasValue restrictions."""
    return rows(restriction, "value", "prop", "filler", hp=TYPE, ho="cls", closed="true")


def some_rows(restriction: DataFrame) -> DataFrame:
    return rows(restriction, "some", "prop", "filler", ho="cls")


def all_rows(restriction: DataFrame) -> DataFrame:
    return rows(restriction, "all", "cls", "prop", ho="filler")


def property_rows(properties: DataFrame, rule: str) -> DataFrame:
    return rows(properties, rule, "p")


@dataclass
class Keys:
    """A set of predicates: listed when there are few, else a frame (p) that was measured small."""
    listed: list[str] | None
    frame: DataFrame | None = None

    def keep(self, facts: DataFrame) -> DataFrame:
        if self.listed is not None:
            return facts.where(F.col("p").isin(self.listed))
        return facts.join(F.broadcast(self.frame), on="p", how="left_semi")


@dataclass
class Rulebook:
    table: DataFrame                    # rule rows
    subclass: DataFrame                 # (src, dst), closed
    subproperty: DataFrame              # (src, dst), closed
    hierarchy: Hierarchy                # of both, by kind; has the equivalent ones as classes
    counts: dict[str, int] = field(default_factory=dict)     # rule -> rows, for non-empty rules
    small: dict[str, bool] = field(default_factory=dict)     # rule -> broadcast, for non-empty rules
    reads: dict[str, list[str]] = field(default_factory=dict)  # rule -> predicates it reads, where they are few
    predicates: Keys | None = None       # predicates any rule reads or writes; None if too many
    heads: Keys | None = None            # predicates any rule writes; None if too many
    type_is_property: bool = False       # rdf:type itself is a key of a property, value, ... rule
    classes: DataFrame | None = None     # classes (o) any rule reads or writes; None if too many

    def has(self, rule: str) -> bool:
        return rule in self.small

    def read_by(self, rule: str, facts: DataFrame) -> DataFrame:
        """Facts whose predicate the rule reads, where the predicates are few enough for a scan filter."""
        return facts.where(F.col("p").isin(self.reads[rule])) if rule in self.reads else facts

    def rule(self, rule: str) -> DataFrame:
        return self.table.where(f"rule = '{rule}'").drop("rule")


def close_schema(ws: Workspace, axioms: DataFrame, settings: Settings) -> Hierarchy:
    """One closure over three tagged graphs, by kind.

    ``class`` and ``property`` are the two hierarchies. ``move`` has two nodes for each property, +p for
    s p o and -p for the same triple with its ends exchanged, so that a path from +p to +q or -q is a
    chain of subproperty, inverse and symmetric steps.
    """
    classes = hierarchy(axioms, v.SUBCLASS_OF, v.EQUIVALENT_CLASS)
    properties = hierarchy(axioms, v.SUBPROPERTY_OF, v.EQUIVALENT_PROPERTY)
    symmetric = property_set(axioms, v.SYMMETRIC).selectExpr("p", "p as q")
    crossed = inverse_pairs(axioms).union(symmetric)
    sides = "explode(array(struct('+' as a, '{}' as b), struct('-' as a, '{}' as b))) as side"
    moves = properties.selectExpr("src as p", "dst as q", sides.format("+", "-")).union(
        crossed.selectExpr("p", "q", sides.format("-", "+")))
    edges = union_all([
        classes.selectExpr("'class' as kind", "src", "dst"),
        properties.selectExpr("'property' as kind", "src", "dst"),
        moves.selectExpr("'move' as kind", "side.a || p as src", "side.b || q as dst"),
    ])
    return close_hierarchy(ws, edges, ["kind"], settings)


def compile_rules(ws: Workspace, axioms: DataFrame, settings: Settings = Settings()) -> Rulebook:
    schema = close_schema(ws, axioms, settings)
    closed = ws.save(schema.pairs(), ws.unique("schema"), partition_by="kind")
    subclass = closed.where("kind = 'class'").select("src", "dst")
    subproperty = closed.where("kind = 'property'").select("src", "dst")
    restriction = restrictions(axioms)
    has_value = restriction.where("kind = 'hasValue'")

    moves = closed.where("kind = 'move' and src like '+%'").selectExpr(
        "substring(src, 2) as p", "substring(dst, 2) as q", "if(dst like '+%', 'keep', 'swap') as place")
    ends = axioms.where(f"p in ('{v.DOMAIN}', '{v.RANGE}')").selectExpr(
        "s as q", "o as cls", f"if(p = '{v.DOMAIN}', 'subject', 'object') as end")
    stays = ends.selectExpr("q as p", "q", "'keep' as place").distinct()
    end = "if(place = 'keep', end, if(end = 'subject', 'object', 'subject')) as place"
    typed = moves.union(stays).join(ends, on="q").selectExpr("p", end, "cls").distinct()

    # Classes whose values would be repeated under too many subclasses, or all whose rows under too many properties
    # and values that imply them. Mostly there are none.
    values_stay, rows_stay = _left_uncomposed(ws, subclass, has_value, typed, settings)

    values = has_value.selectExpr("cls as dst", "prop", "filler")
    if values_stay is not None:
        values = values.join(values_stay.toDF("dst"), "dst", "left_anti")
    class_part = union_all([
        _opened(class_types(subclass.toDF("cls", "sup")), values_stay),
        class_values(has_value),
        class_values(values.join(subclass, on="dst").withColumnRenamed("src", "cls")),
    ])
    heads_of_class = class_part.selectExpr("k1 as cls", "hp", "ho", "closed")
    if rows_stay is not None:
        heads_of_class = heads_of_class.join(rows_stay, "cls", "left_anti")
    property_part = union_all([
        rows(moves, "property", "p", place="place", hp="q", closed="false"),
        _opened(rows(typed, "property", "p", place="place", hp=TYPE, ho="cls", closed="true"), rows_stay),
        rows(typed.join(heads_of_class, on="cls"), "property", "p", place="place", hp="hp", ho="ho",
             closed="closed"),
    ])
    value_part = union_all([
        _opened(value_types(has_value), rows_stay),
        rows(has_value.join(heads_of_class, on="cls"), "value", "prop", "filler", hp="hp", ho="ho",
             closed="closed"),
    ])
    heads = restriction.where("kind in ('some', 'all')").selectExpr("if(kind = 'some', cls, filler) as ho").distinct()
    with_rows = heads.join(class_part.selectExpr("k1 as ho"), "ho", "left_semi").toDF("cls")
    met = union_all([some_rows(restriction.where("kind = 'some'")), all_rows(restriction.where("kind = 'all'"))])
    rest = union_all([
        _opened(met.withColumn("closed", F.lit(True)), with_rows),
        property_rows(property_set(axioms, v.TRANSITIVE), "transitive"),
        property_rows(property_set(axioms, v.FUNCTIONAL), "functional"),
        property_rows(property_set(axioms, v.INVERSE_FUNCTIONAL), "inverse_functional"),
    ])
    table = (
        union_all([property_part, class_part, value_part, rest])
        .groupBy("rule", "k1", "k2", "place", "hp", "ho").agg(F.max("closed").alias("closed"))
    )
    book = Rulebook(ws.save(table, ws.unique("rules"), partition_by="rule"), subclass, subproperty, schema)
    _measure(ws, book, settings)
    return book


def _opened(table: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Rule rows with the heads of ``classes`` (cls) not closed."""
    if classes is None:
        return table
    marked = classes.select(F.col("cls").alias("ho"), F.lit(True).alias("open"))
    return table.join(marked, "ho", "left").withColumn("closed", F.col("closed") & F.col("open").isNull()).select(
        "rule", "k1", "k2", "place", "hp", "ho", "closed")


def _left_uncomposed(ws: Workspace, subclass: DataFrame, has_value: DataFrame, typed: DataFrame,
                     settings: Settings) -> tuple[DataFrame | None, DataFrame | None]:
    """The classes (cls) whose values, and those whose rows, make too many rows where they would be repeated.

    The products are of counts by class, so nothing is joined to find that a join would be too large. Only classes
    with values, domains or ranges are counted.
    """
    asked = has_value.select("cls", F.lit(1).alias("value")).unionByName(typed.select("cls", F.lit(0).alias("value")))
    asked = ws.save(asked.groupBy("cls").agg(F.sum("value").alias("valued"), F.count("*").alias("implied")),
                    ws.unique("implying"))
    # Of its superclasses a class takes the types, and their values, at most all there are.
    below = subclass.selectExpr("dst as cls").join(asked.where("valued > 0"), "cls", "left_semi").groupBy("cls").agg(
        F.count("*").alias("below"))
    above = (
        subclass.toDF("cls", "sup").join(asked.select("cls"), "cls", "left_semi")
        .join(asked.select(F.col("cls").alias("sup"), "valued"), "sup", "left")
        .groupBy("cls").agg(F.sum(1 + F.coalesce("valued", F.lit(0))).alias("above")))
    limit = settings.compose_rows
    large = ws.save(asked.join(below, "cls", "left").join(above, "cls", "left").selectExpr(
        "cls", f"valued * coalesce(below, 0) > {limit} as values_stay",
        f"implied * (valued + coalesce(above, 0)) > {limit} as rows_stay").where("values_stay or rows_stay"),
        ws.unique("uncomposed"))
    if large.isEmpty():
        return None, None
    return large.where("values_stay").select("cls"), large.where("rows_stay").select("cls")


def _measure(ws: Workspace, book: Rulebook, settings: Settings) -> None:
    """Sizes of the rule tables, and which predicates and classes they touch, in one job.

    At most ``filter_values`` + 1 predicate names, as many of each rule that reads few, and one row per rule reach the
    driver.
    """
    def size(df, what, name, columns):
        width = " + ".join(f"coalesce(octet_length({c}), 0)" for c in columns)
        return df.groupBy(F.expr(name).alias("name")).agg(
            F.expr("count(*) as n"), F.expr(f"coalesce(sum({width}), 0) as bytes"),
        ).selectExpr(f"'{what}' as what", "name", "n", "bytes", "false as read", "false as write", "false as moved",
                     "cast(array() as array<string>) as rules")

    body = "case rule when 'all' then k2 when 'class' then null else k1 end"
    head = f"""case when rule in ('property', 'class', 'value') then hp
                    when rule in ('some', 'all') then {TYPE} when rule = 'transitive' then k1 end"""
    moved = "coalesce(place in ('keep', 'swap'), false)"
    touched = (
        book.table.selectExpr(
            f"inline(array(struct({body} as p, rule as reader, true as read, false as write, false as moved),"
            f" struct({head} as p, null as reader, false as read, true as write, {moved} as moved)))")
        .where("p is not null").groupBy("p")
        .agg(F.max("read").alias("read"), F.max("write").alias("write"), F.max("moved").alias("moved"),
             F.collect_set("reader").alias("rules"))
    )
    names = touched.selectExpr("'predicate' as what", "p as name", "1 as n", "0 as bytes", "read", "write", "moved",
                               "rules")
    classes = (
        book.table.selectExpr(
            "explode(array(if(rule in ('class', 'all'), k1, null), if(rule = 'some', k2, null),"
            f" if(rule in ('some', 'all') or hp = {TYPE}, ho, null))) as o")
        .where("o is not null").distinct()
    )
    report = union_all([
        size(book.table, "rule", "rule", ["k1", "k2", "hp", "ho"]),
        size(classes, "classes", "'classes'", ["o"]),
        # rdf:type first, so that it is never cut off.
        names.orderBy(F.expr(f"name <> {TYPE}")).limit(settings.filter_values + 1),
        size(touched, "predicates", "'predicates'", ["p"]),
        size(touched.selectExpr("explode(rules) as rule", "p"), "reads", "rule", ["p"]),
    ]).collect()

    def fits(r):
        return r.n <= settings.broadcast_rows and r.bytes <= settings.broadcast_bytes

    book.counts = {r.name: r.n for r in report if r.what == "rule"}
    book.small = {r.name: fits(r) for r in report if r.what == "rule"}
    named = [r for r in report if r.what == "predicate"]
    always = {v.SAME_AS, v.TYPE} if any(book.has(rule) for rule in ("class", "some", "all")) else {v.SAME_AS}
    if len(named) <= settings.filter_values:
        book.predicates = Keys(sorted({r.name for r in named} | always))
        book.heads = Keys(sorted(r.name for r in named if r.write))
        book.reads = {rule: sorted(r.name for r in named if rule in r.rules) for rule in book.small}
    else:
        few = [r.name for r in report if r.what == "reads" and r.n <= settings.filter_values]
        listed = touched.selectExpr("explode(rules) as rule", "p").where(F.col("rule").isin(few)).collect()
        book.reads = {rule: sorted(r.p for r in listed if r.rule == rule) for rule in few}
    if book.predicates is None and all(fits(r) for r in report if r.what == "predicates"):
        kept = ws.save(touched.select("p", "write"), ws.unique("predicates"))
        extra = book.table.sparkSession.createDataFrame([(p,) for p in sorted(always)], "p string")
        book.predicates = Keys(None, kept.select("p").union(extra))
        book.heads = Keys(None, kept.where("write").select("p"))
    book.type_is_property = any(r.name == v.TYPE and r.read for r in named)
    # A rule that moves any object under rdf:type can write any class, so no class can be left out.
    any_class = book.type_is_property or any(r.name == v.TYPE and r.moved for r in named)
    if not any_class and all(fits(r) for r in report if r.what == "classes"):
        book.classes = classes
