"""Small graphs written as ``s p o; s p o``, and random ones."""

import random

from triplewright import vocab as v

WORDS = {
    "sub": v.SUBCLASS_OF, "subProp": v.SUBPROPERTY_OF, "equivClass": v.EQUIVALENT_CLASS,
    "equivProp": v.EQUIVALENT_PROPERTY, "type": v.TYPE, "domain": v.DOMAIN, "range": v.RANGE,
    "inverseOf": v.INVERSE_OF, "sameAs": v.SAME_AS, "onProperty": v.ON_PROPERTY, "hasValue": v.HAS_VALUE,
    "some": v.SOME_VALUES_FROM, "all": v.ALL_VALUES_FROM, "Functional": v.FUNCTIONAL,
    "InverseFunctional": v.INVERSE_FUNCTIONAL, "Symmetric": v.SYMMETRIC, "Transitive": v.TRANSITIVE,
}


def term(word, space):
    if word.startswith('"'):
        return word
    return WORDS.get(word) or f"<{space}:{word}>"


def graph(text, space):
    """Triples of a text, their names put into a space of their own."""
    return [tuple(term(w, space) for w in part.split()) for part in text.split(";") if part.strip()]


def random_graph(seed, space, meta=False):
    rng = random.Random(seed)
    nodes, classes, props = [f"n{i}" for i in range(7)], [f"C{i}" for i in range(5)], [f"p{i}" for i in range(5)]
    if meta:
        props = [*props[:3], "type", "sameAs"]
    marks = ["Functional", "InverseFunctional", "Symmetric", "Transitive"]
    out = []

    def add(n, make):
        out.extend(f"{s} {p} {o}" for s, p, o in (make() for _ in range(rng.randint(0, n))))

    pick = rng.choice
    add(4, lambda: (pick(classes), pick(["sub", "sub", "equivClass"]), pick(classes)))
    add(3, lambda: (pick(props), pick(["subProp", "subProp", "equivProp"]), pick(props)))
    add(2, lambda: (pick(props), "inverseOf", pick(props)))
    add(2, lambda: (pick(props), "type", pick(marks)))
    add(2, lambda: (pick(props), pick(["domain", "range"]), pick(classes)))
    for _ in range(rng.randint(0, 3)):
        c = pick(classes)
        out.append(f"{c} onProperty {pick(props)}")
        kind = pick(["hasValue", "some", "all"])
        out.append(f"{c} {kind} {pick(nodes + ['\"x\"']) if kind == 'hasValue' else pick(classes)}")
    add(12, lambda: (pick(nodes), pick(props), pick(nodes)))
    add(4, lambda: (pick(nodes), "type", pick(classes)))
    add(2, lambda: (pick(nodes), "sameAs", pick(nodes)))
    add(2, lambda: (pick(nodes), pick(props), f'"{pick("xyz")}"'))
    return graph(";".join(out), space)
