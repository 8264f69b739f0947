"""The rules once more, one at a time on Python sets. Only for small graphs in tests."""

from collections import defaultdict

from triplewright import vocab as v


def transitive(pairs):
    pairs = {(a, b) for a, b in pairs if a != b}
    while True:
        after = defaultdict(set)
        for a, b in pairs:
            after[a].add(b)
        more = {(a, c) for a, b in pairs for c in after.get(b, ()) if a != c} - pairs
        if not more:
            return pairs
        pairs |= more


def schema(triples):
    by = defaultdict(set)
    for s, p, o in triples:
        by[p].add((s, o))
    def mirrored(p):
        return by[p] | {(b, a) for a, b in by[p]}
    return by, transitive(by[v.SUBCLASS_OF] | mirrored(v.EQUIVALENT_CLASS)), transitive(
        by[v.SUBPROPERTY_OF] | mirrored(v.EQUIVALENT_PROPERTY))


def _index(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    return out


def step(facts, by, sub, subp):
    """Everything one application of each rule gives."""
    declared = {c: {s for s, o in by[v.TYPE] if o == c} for c in v.PROPERTY_CLASSES}
    sub, subp = _index(sub), _index(subp)
    inverse = _index(by[v.INVERSE_OF] | {(b, a) for a, b in by[v.INVERSE_OF]})
    domain, range_ = _index(by[v.DOMAIN]), _index(by[v.RANGE])
    on = _index(by[v.ON_PROPERTY])
    value = {(c, p, w) for c, w in by[v.HAS_VALUE] for p in on[c]}
    some = {(c, p, w) for c, w in by[v.SOME_VALUES_FROM] for p in on[c]}
    all_ = {(c, p, w) for c, w in by[v.ALL_VALUES_FROM] for p in on[c]}
    members, objects = defaultdict(set), defaultdict(set)
    for s, p, o in facts:
        objects[p, s].add(o)
        if p == v.TYPE:
            members[s].add(o)
    for s, p, o in facts:
        for q in subp.get(p, ()):
            yield s, q, o
        for q in inverse.get(p, ()):
            yield o, q, s
        if p in declared[v.SYMMETRIC]:
            yield o, p, s
        if p in declared[v.TRANSITIVE]:
            for z in objects.get((p, o), ()):
                if s != z:
                    yield s, p, z
        for c in domain.get(p, ()):
            yield s, v.TYPE, c
        for c in range_.get(p, ()):
            yield o, v.TYPE, c
        for c, q, w in value:
            if (q, w) == (p, o):
                yield s, v.TYPE, c
            if p == v.TYPE and o == c:
                yield s, q, w
        for c, q, w in some:
            if q == p and w in members.get(o, ()):
                yield s, v.TYPE, c
        for c, q, w in all_:
            if q == p and c in members.get(s, ()):
                yield o, v.TYPE, w
        if p == v.TYPE:
            for c in sub.get(o, ()):
                yield s, v.TYPE, c


def infer(triples):
    """(new triples but types and sameAs, new types, new sameAs pairs)."""
    asserted = set(triples)
    by, sub, subp = schema(asserted)
    facts = set(asserted)
    while True:
        more = set(step(facts, by, sub, subp)) - facts
        if not more:
            break
        facts |= more
    new = facts - asserted
    links = {(s, o) for s, p, o in facts if p == v.SAME_AS}
    functional = {s for s, o in by[v.TYPE] if o == v.FUNCTIONAL}
    inverse = {s for s, o in by[v.TYPE] if o == v.INVERSE_FUNCTIONAL}
    groups = defaultdict(set)
    for s, p, o in facts:
        if p in functional:
            groups["f", s, p].add(o)
        if p in inverse:
            groups["i", o, p].add(s)
    for group in groups.values():
        links |= {(a, b) for a in group for b in group}
    same = transitive(links | {(b, a) for a, b in links})
    stated = {(s, o) for s, p, o in asserted if p == v.SAME_AS}
    return (
        {t for t in new if t[1] not in (v.TYPE, v.SAME_AS)},
        {(s, o) for s, p, o in new if p == v.TYPE},
        same - stated,
    )
