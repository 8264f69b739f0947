"""RDF, RDFS and OWL terms used by the rules, in N-Triples surface form."""

# The W3C namespace addresses and term names.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

TYPE = f"<{RDF}type>"

SUBCLASS_OF = f"<{RDFS}subClassOf>"
SUBPROPERTY_OF = f"<{RDFS}subPropertyOf>"
DOMAIN = f"<{RDFS}domain>"
RANGE = f"<{RDFS}range>"

EQUIVALENT_CLASS = f"<{OWL}equivalentClass>"
EQUIVALENT_PROPERTY = f"<{OWL}equivalentProperty>"
INVERSE_OF = f"<{OWL}inverseOf>"
SAME_AS = f"<{OWL}sameAs>"
ON_PROPERTY = f"<{OWL}onProperty>"
HAS_VALUE = f"<{OWL}hasValue>"
SOME_VALUES_FROM = f"<{OWL}someValuesFrom>"
ALL_VALUES_FROM = f"<{OWL}allValuesFrom>"

FUNCTIONAL = f"<{OWL}FunctionalProperty>"
INVERSE_FUNCTIONAL = f"<{OWL}InverseFunctionalProperty>"
SYMMETRIC = f"<{OWL}SymmetricProperty>"
TRANSITIVE = f"<{OWL}TransitiveProperty>"

# Predicates whose rows are schema axioms.
AXIOM_PREDICATES = (
    SUBCLASS_OF, SUBPROPERTY_OF, DOMAIN, RANGE, EQUIVALENT_CLASS, EQUIVALENT_PROPERTY,
    INVERSE_OF, ON_PROPERTY, HAS_VALUE, SOME_VALUES_FROM, ALL_VALUES_FROM,
)
# Classes that, as the object of rdf:type, state a property characteristic.
PROPERTY_CLASSES = (FUNCTIONAL, INVERSE_FUNCTIONAL, SYMMETRIC, TRANSITIVE)
