"""Terms, rules and conditions of SKOS and SKOS-XL.

Terms are written with prefixes, as the statement store holds them.  ``PREFIXES`` expands them.
"""

from __future__ import annotations

# The well-known namespaces.
PREFIXES = {
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "skosxl": "http://www.w3.org/2008/05/skos-xl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "dcterms": "http://purl.org/dc/terms/",
    "prov": "http://www.w3.org/ns/prov#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}

CLASSES = ("skos:Concept", "skos:ConceptScheme", "skos:Collection", "skos:OrderedCollection", "skosxl:Label")
LABELS = ("skos:prefLabel", "skos:altLabel", "skos:hiddenLabel")
LABEL_KINDS = dict(zip(LABELS, ("preferred", "alternative", "hidden")))
XL_LABELS = ("skosxl:prefLabel", "skosxl:altLabel", "skosxl:hiddenLabel")
RELATIONS = ("skos:broader", "skos:narrower", "skos:related", "skos:broaderTransitive", "skos:narrowerTransitive")
MAPPINGS = ("skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch", "skos:closeMatch", "skos:exactMatch")
NOTE = "skos:note"
NOTES = (NOTE, "skos:changeNote", "skos:definition", "skos:editorialNote", "skos:example", "skos:historyNote", "skos:scopeNote")
PLAIN = ("xsd:string", "rdf:langString")

#: property -> (its converse, the rule that says so)
RELATION_CONVERSE = {
    "skos:broader": ("skos:narrower", "S25"), "skos:narrower": ("skos:broader", "S25"), "skos:related": ("skos:related", "S23"),
    "skos:broaderTransitive": ("skos:narrowerTransitive", "S26"), "skos:narrowerTransitive": ("skos:broaderTransitive", "S26"),
}
MAPPING_CONVERSE = {
    "skos:broadMatch": ("skos:narrowMatch", "S43"), "skos:narrowMatch": ("skos:broadMatch", "S43"), "skos:relatedMatch": ("skos:relatedMatch", "S44"),
    "skos:closeMatch": ("skos:closeMatch", "S44"), "skos:exactMatch": ("skos:exactMatch", "S44"),
}
#: mapping -> the semantic relation it is a sub-property of (S41)
LIFTED = {"skos:broadMatch": "skos:broader", "skos:narrowMatch": "skos:narrower", "skos:relatedMatch": "skos:related"}
#: relation -> its transitive super-property (S22)
TRANSITIVE = {"skos:broader": "skos:broaderTransitive", "skos:narrower": "skos:narrowerTransitive"}
XL_CHAIN = {"skosxl:prefLabel": ("skos:prefLabel", "S55"), "skosxl:altLabel": ("skos:altLabel", "S56"), "skosxl:hiddenLabel": ("skos:hiddenLabel", "S57")}

#: object property -> the rule that makes a literal there an error
OBJECT_PROPERTIES = {
    **dict.fromkeys(("skos:inScheme", "skos:hasTopConcept", "skos:topConceptOf"), "S3"),
    **dict.fromkeys(("skos:semanticRelation", *RELATIONS), "S18"),
    **dict.fromkeys(("skos:member", "skos:memberList"), "S30"),
    **dict.fromkeys(("skos:mappingRelation", *MAPPINGS), "S38"),
    **dict.fromkeys(XL_LABELS, "S53"),
    "skosxl:labelRelation": "S59",
}
DISJOINT_CLASSES = (
    ("skos:ConceptScheme", "skos:Concept", "S9"), ("skos:Collection", "skos:Concept", "S37"), ("skos:Collection", "skos:ConceptScheme", "S37"),
    ("skosxl:Label", "skos:Concept", "S48"), ("skosxl:Label", "skos:ConceptScheme", "S48"), ("skosxl:Label", "skos:Collection", "S48"),
)

# What each rule of the SKOS Reference says, in short.
RULES = {
    "S3": "inScheme, hasTopConcept and topConceptOf take resources",
    "S4": "what a resource is in the scheme of is a concept scheme",
    "S5": "what has a top concept is a concept scheme",
    "S6": "a top concept is a concept",
    "S7": "a top concept of a scheme is in the scheme",
    "S8": "topConceptOf and hasTopConcept are converses",
    "S9": "no concept scheme is a concept",
    "S12": "labels are plain literals",
    "S13": "a label is of one kind only",
    "S14": "one preferred label per language",
    "S16": "notes may be resources or literals",
    "S17": "each kind of note is a note",
    "S18": "semantic relations take resources",
    "S19": "the subject of a semantic relation is a concept",
    "S20": "the object of a semantic relation is a concept",
    "S21": "the transitive relations and related are semantic relations",
    "S22": "broader and narrower imply their transitive forms",
    "S23": "related is symmetric",
    "S24": "the transitive relations are transitive",
    "S25": "broader and narrower are converses",
    "S26": "the transitive relations are converses",
    "S27": "related and broaderTransitive exclude each other",
    "S29": "an ordered collection is a collection",
    "S30": "member and memberList take resources",
    "S31": "what has a member is a collection",
    "S33": "what has a member list is an ordered collection",
    "S36": "each item of a member list is a member",
    "S37": "no collection is a concept or a concept scheme",
    "S38": "mappings take resources",
    "S39": "a mapping is a semantic relation",
    "S40": "the four kinds of match are mappings",
    "S41": "the hierarchical and associative matches imply the relations",
    "S42": "an exact match is a close match",
    "S43": "broadMatch and narrowMatch are converses",
    "S44": "relatedMatch, closeMatch and exactMatch are symmetric",
    "S45": "exactMatch is transitive",
    "S46": "exactMatch excludes broadMatch and relatedMatch",
    "S48": "no label resource is a concept, scheme or collection",
    "S49": "literalForm takes literals",
    "S50": "what has a literal form is a label resource",
    "S51": "a literal form is a plain literal",
    "S52": "a label resource has exactly one literal form",
    "S53": "the SKOS-XL labelling properties take resources",
    "S54": "what they take is a label resource",
    "S55": "the form of an XL preferred label is a preferred label",
    "S56": "the form of an XL alternative label is an alternative label",
    "S57": "the form of an XL hidden label is a hidden label",
    "S58": "an XL label is of one kind only",
    "S59": "labelRelation takes resources",
    "S60": "the subject of labelRelation is a label resource",
    "S61": "the object of labelRelation is a label resource",
    "S62": "labelRelation is symmetric",
    "rdfs5": "sub-properties chain",
    "rdfs7": "a statement holds for super-properties",
}

_CLASSING = (
    "skos:Concept", "skos:ConceptScheme", "skos:Collection", "skos:OrderedCollection", "skos:inScheme", "skos:hasTopConcept", "skos:topConceptOf",
    "skos:member", "skos:memberList", "skos:semanticRelation", *RELATIONS, "skos:mappingRelation", *MAPPINGS,
)
_MAPPING = ("skos:mappingRelation", *MAPPINGS)

# The conditions, in order, with section, authority ('specification' or 'reading') and the terms they rest on.
CONDITIONS = (
    ("S9", "4.4", "specification", _CLASSING),
    ("S13", "5.4", "specification", (*LABELS, *XL_LABELS, "skosxl:literalForm")),
    ("S14", "5.4", "specification", ("skos:prefLabel", "skosxl:prefLabel", "skosxl:literalForm")),
    ("S27", "8.4", "specification", ("skos:semanticRelation", *RELATIONS, *_MAPPING)),
    ("S37", "9.4", "specification", _CLASSING),
    ("S46", "10.4", "specification", _MAPPING),
    ("S3", "4.2", "reading", ("skos:inScheme", "skos:hasTopConcept", "skos:topConceptOf")),
    ("S18", "8.2", "reading", ("skos:semanticRelation", *RELATIONS)),
    ("S30", "9.2", "reading", ("skos:member", "skos:memberList")),
    ("S38", "10.2", "reading", _MAPPING),
    ("S48", "B.2", "reading", (*_CLASSING, "skosxl:Label", "skosxl:literalForm", *XL_LABELS, "skosxl:labelRelation")),
    ("S49", "B.2", "reading", ("skosxl:literalForm",)),
    ("S52", "B.2", "reading", ("skosxl:literalForm", "skosxl:Label")),
    ("S53", "B.3", "reading", XL_LABELS),
    ("S58", "B.3", "reading", XL_LABELS),
    ("S59", "B.4", "reading", ("skosxl:labelRelation",)),
)

#: finding -> severity
SEVERITY = {
    "DisjointClasses": "inconsistent", "DefectiveMemberList": "ill-formed", "MultipleMemberLists": "ill-formed", "MultiplePreferredLabels": "inconsistent",
    "LabelPropertiesClash": "inconsistent", "NonPlainLiteralLabel": "ill-formed", "LiteralOnObjectProperty": "inconsistent", "NodeOnDatatypeProperty": "inconsistent",
    "MultipleLiteralForms": "inconsistent", "NoLiteralForm": "ill-formed", "NonPlainLiteralForm": "ill-formed", "XlLabelPropertiesClash": "inconsistent",
    "RelatedAndBroaderTransitive": "inconsistent", "ExactMatchClash": "inconsistent", "ExactMatchChainClash": "inconsistent",
    "ExactMatchClusterBoundReached": "unchecked", "ExactMatchSweepExhausted": "unchecked", "AncestryBoundReached": "unchecked",
    "DisjointnessSweepExhausted": "unchecked", "RefinementBoundReached": "unchecked",
}
