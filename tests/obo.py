"""Toy ontologies as OBO text."""

from __future__ import annotations


def obo(*terms: dict, header: str = "format-version: 1.2\ndata-version: test") -> str:
    out = [header]
    for t in terms:
        lines = ["[Term]"]
        for tag, value in t.items():
            for v in value if isinstance(value, list) else [value]:
                lines.append(f"{tag}: {v}")
        out.append("\n".join(lines))
    return "\n\n".join(out) + "\n"


ENRICHMENT = obo(
    {"id": "root", "name": "All"},
    {"id": "branchA", "name": "Child1", "is_a": "root ! All"},
    {"id": "branchB", "name": "Child2", "is_a": "root"},
    {"id": "branchAChild1", "name": "Child4", "alt_id": "branchAChild3", "is_a": "branchA", "xref": ["wikipedia", "HP:12", "DO:37"], "synonym": '"fourth" EXACT []', "def": '"A leaf." [x]'},
    {"id": "branchAChild2", "name": "Child5", "is_a": "branchA"},
)
CHAIN = obo(
    {"id": "Parental", "name": "All"},
    {"id": "Child2", "name": "Child2", "is_a": "Parental", "alt_id": ["Child3", "Child4", "Child2"], "synonym": '"1,6-alpha-mannosyltransferase activity" EXACT []'},
    {"id": "Child1", "name": "Child1", "is_obsolete": "true", "is_a": "Parental", "replaced_by": "Child2"},
    {"id": "Child5", "name": "Child5", "is_obsolete": "true", "is_a": "Parental"},
    {"id": "Child3", "name": "Child3", "is_obsolete": "true"},
    {"id": "Child10", "name": "Child10", "is_obsolete": "true", "replaced_by": "Child3"},
    {"id": "Child11", "name": "Child11", "is_obsolete": "true", "replaced_by": "Child10"},
)
BRANCHED = obo(
    {"id": "Parental", "name": "All"},
    *({"id": c, "name": f"{c}name", "is_a": p} for c, p in (("ChildA", "Parental"), ("ChildB", "Parental"), ("ChildA1", "ChildA"), ("ChildA2", "ChildA"), ("ChildB1", "ChildB"), ("ChildB2", "ChildB"))),
)
SPARSE = obo({"id": "A"}, {"id": "B", "is_a": "A"}, {"id": "C", "is_a": "A"}, {"id": "D"})
ATOMIC = obo({"id": "Parental"}, {"id": "Child1"}, {"id": "Child2"})
CIRCULAR = obo({"id": "A", "is_a": "C"}, {"id": "B", "is_a": "A"}, {"id": "C", "is_a": "B"})
PROFILES = {
    "P1": ["root", "branchAChild1", "branchA"],
    "P2": ["root", "branchB", "branchAChild1"],
    "P3": ["branchAChild1", "root", "branchAChild2"],
    "P4": ["branchA"],
    "P5": ["branchAChild1"],
}


def profile_table(spark, profiles: dict[str, list[str]]):
    rows = [(p, k, t) for p, ts in profiles.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "profile_id string, pos int, term_id string")
