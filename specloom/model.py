"""Schemas of specification documents and of migrations. Ordered lists keep their order as array positions."""

from __future__ import annotations

import re

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """The struct that a list of ``name type`` means; types are string, boolean, array<> and struct<>. Needs no session."""
    words = re.findall(r"\w+|[<>:,]", spec)

    def fields(end: str | None) -> T.StructType:
        out = T.StructType()
        while words and words[0] != end:
            name = words.pop(0)
            if words[0] == ":":
                words.pop(0)
            out.add(name, kind())
            if words and words[0] == ",":
                words.pop(0)
        return out

    def kind() -> T.DataType:
        word = words.pop(0)
        if word in ("string", "boolean"):
            return T.StringType() if word == "string" else T.BooleanType()
        words.pop(0)
        out = fields(">") if word == "struct" else T.ArrayType(kind())
        words.pop(0)
        return out

    return fields(None)


# The sections and keys of a document.
#: Literal values (defaults, constraint values) are JSON texts; parse_json turns them into VARIANT.
DOCUMENT = """
metadata struct<version: string, author: string, description: string, created: string, updated: string>,
system struct<id: string, name: string, description: string, components: array<string>, relationships: array<struct<from: string, to: string, type: string, description: string>>>,
entities array<struct<id: string, name: string, description: string,
    fields: array<struct<name: string, type: string, description: string, required: boolean, default: string, constraints: array<struct<type: string, value: string, message: string>>>>,
    relationships: array<struct<entity: string, type: string, description: string>>>>,
actions array<struct<id: string, name: string, description: string, input: struct<entity: string, fields: array<string>, description: string>, output: struct<entity: string, fields: array<string>, description: string>,
    side_effects: array<string>, preconditions: array<string>, postconditions: array<string>>>,
features array<struct<id: string, title: string, description: string, scenarios: array<struct<id: string, title: string, description: string, given: array<string>, when: array<string>, then: array<string>>>,
    acceptance_criteria: array<string>, dependencies: array<string>>>,
flows array<struct<id: string, name: string, description: string, steps: array<struct<id: string, action: string, description: string, conditions: array<string>, on_success_action_id: string, on_failure_action_id: string>>>>,
constraints array<struct<id: string, name: string, description: string, type: string, rule: string, entities: array<string>, actions: array<string>>>,
traceability array<struct<from: string, to: string, relation: string, description: string>>,
generation_rules array<struct<id: string, name: string, description: string, triggers: array<string>, generates: array<string>, template: string>>
"""

# Required keys.
#: What a document must have, by path; a missing one makes the whole document unreadable. ``[]`` steps into each element.
REQUIRED = {
    "metadata": ["version"], "system": ["id", "name", "components", "relationships"], "system.relationships[]": ["from", "to", "type"],
    "entities[]": ["id", "fields"], "entities[].fields[]": ["name", "type"], "entities[].fields[].constraints[]": ["type"], "entities[].relationships[]": ["entity", "type"],
    "actions[]": ["id"], "features[]": ["id", "title", "scenarios"], "features[].scenarios[]": ["id", "title", "given", "when", "then"],
    "flows[]": ["id", "name", "steps"], "flows[].steps[]": ["id", "action"], "constraints[]": ["id", "name", "type", "rule"],
    "traceability[]": ["from", "to", "relation"], "generation_rules[]": ["id", "name", "triggers", "generates"],
}

OPERATION = "type string, id string, title string, name string, description string, scenarios array<string>, condition string, applies_to string, message string, entity_id string, field_name string, field_type string, required boolean, default string, new_name string, new_description string, target_id string, target_type string"
MIGRATION = f"id string, title string, description string, dependencies array<string>, up array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in OPERATION.split(', ')))}>>, down array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in OPERATION.split(', ')))}>>"

#: Sections in the order in which rules visit them.
SECTIONS = ["entities", "features", "actions", "flows", "constraints", "traceability"]


def document_type() -> T.StructType:
    return _struct(DOCUMENT)


def migration_type() -> T.StructType:
    return _struct(MIGRATION)


#: Metadata beside a feature file.
FEATURE_META = "feature struct<id: string, name: string, description: string, file: string, scenarios: array<struct<id: string, title: string, line: string, action: string, traceability: array<struct<to: string, relation: string>>>>>"


def feature_meta_type() -> T.StructType:
    return _struct(FEATURE_META)


# Design principles by group, code and name.
PRINCIPLES = {
    "Structure": {"Si": "Simplicity", "Mo": "Modularity", "Co": "Composability", "Ex": "Extensibility", "Pm": "Policy/Mechanism Separation", "Gr": "Generalized Design"},
    "Efficiency": {"Sc": "Scalability", "Rc": "Reuse of Computation", "Wv": "Work Avoidance", "Cc": "Common-Case Specialization", "Bo": "Bottleneck-Oriented", "Ha": "Hardware-Aware", "Op": "Optimistic Design", "La": "Learned Approximation"},
    "Semantics": {"Al": "Abstraction Lifting", "Lu": "Language Homogeneity", "Se": "Semantically Explicit", "Fs": "Formal Specification", "Ig": "Invariant-Guided"},
    "Distribution": {"Lt": "Location Transparency", "Dc": "Decentralized Control", "Fp": "Function Placement", "Lo": "Locality of Reference"},
    "Planning": {"Ep": "Equivalence-based", "Cm": "Cost-based", "Cp": "Constraint-based", "Gd": "Goal-Directed", "Bb": "Black-Box Tuning", "Ah": "Advisory Hinting"},
    "Operability": {"Ad": "Adaptive Processing", "Ec": "Elasticity", "Wa": "Workload-Aware", "Au": "Automation", "Ho": "Human Observability", "Ev": "Evolvability"},
    "Reliability": {"Ft": "Fault Tolerance", "Is": "Isolation", "At": "Atomic Execution", "Cr": "Consistency Relaxation"},
    "Security": {"Sy": "Security via Isolation", "Ac": "Access Control", "Lp": "Least Privilege", "Tq": "Trust via Quorum", "Cf": "Conservative Defaults", "Sa": "Safety by Construction"},
}
