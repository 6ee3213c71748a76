"""Switches between the standard's semantics and the looser ones of the widely used older behaviour."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Mode:
    """True is the standard's meaning (``STRICT``); false the older one (``COMPAT``)."""

    class_by_subclass: bool = True  # sh:class accepts instances of subclasses
    datatype_well_formed: bool = True  # sh:datatype also checks the lexical form
    length_in_characters: bool = True  # lengths count characters, not bytes, and IRIs have lengths
    pattern_on_iris: bool = True  # sh:pattern tests IRIs; blank nodes violate
    language_ranges: bool = True  # sh:languageIn matches ranges; what has no tag violates
    unique_lang_flag: bool = True  # sh:uniqueLang false is off
    equals_as_sets: bool = True  # sh:equals reports the values on either side alone
    less_than_each_pair: bool = True  # sh:lessThan must hold for every pair
    compare_by_datatype: bool = True  # comparisons go by datatype, not by spelling
    ignored_as_list: bool = True  # sh:ignoredProperties lists count
    closed_direct_only: bool = True  # sh:closed allows direct predicates only
    closed_reports_predicate: bool = True  # sh:closed results name the predicate as their path
    closed_on_properties: bool = True  # sh:closed also on property shapes
    deactivated_everywhere: bool = True  # sh:deactivated also on nested shapes
    own_severity: bool = True  # nested property shapes keep their own severity
    literal_objects: bool = False  # sh:targetObjectsOf keeps literals (off: they are dropped)
    cycle_back: bool = True  # path+ reaches its start on a cycle
    siblings_disjoint_only: bool = True  # sibling shapes are those of shapes with the flag's parent, literals may conform
    all_values: bool = True  # every value of sh:not, sh:datatype, … counts, not the first only
    sparql_result_columns: bool = True  # ?value and ?path of SPARQL results are used; once a focus


STRICT = Mode()
COMPAT = Mode(**{f.name: False for f in fields(Mode)})
