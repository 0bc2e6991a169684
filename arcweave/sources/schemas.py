"""Schemas of the node, edge and diagnostic tables and the confidence scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence names by number, edge kinds in their sort order.
CONFIDENCE = ("low", "medium", "high", "certain")
EDGE_KINDS = ("references", "produces", "targets", "invokes", "accepts", "returns", "fieldOf", "dependsOn")

LOCATION = "struct<path:string,line:int>"
TABLES = {
    "repos": "id string, name string, path string, headSha string, dirty boolean",
    "projects": "id string, repo string, name string, path string, kind string, sdk string, packageId string, version string, isPackable boolean",
    "packages": "id string, packageId string, producerProjectIds array<string>",
    "endpoints": f"id string, repo string, projectId string, verb string, route string, normalizedRoute string, handler string, parameters array<struct<name:string,source:string,typeName:string,required:boolean,default:string>>, responses array<struct<statusCode:int,typeName:string>>, location {LOCATION}",
    "clientMethods": f"id string, repo string, projectId string, typeName string, methodName string, signature string, verb string, route string, normalizedRoute string, strategy string, confidence string, location {LOCATION}",
    "callSites": f"id string, repo string, projectId string, containingMember string, confidence string, location {LOCATION}",
    "models": f"id string, repo string, projectId string, fullName string, kind string, fields array<struct<name:string,typeName:string,nullable:boolean,collection:boolean>>, enumValues array<string>, location {LOCATION}",
    "edges": "kind string, from string, to string, confidence string, version string, strategy string, source string, statusCode int, fieldName string, viaPackages array<string>, callCount int",
    "diagnostics": "kind string, severity string, nodeIds array<string>, message string",
}


def document_schema() -> str:
    """Of the whole graph document, for Spark's JSON reader."""
    nested = lambda ddl: ", ".join(f"`{f.split(' ', 1)[0]}`:{f.split(' ', 1)[1]}" for f in _fields(ddl))
    return "schemaVersion int, generatedAt string, " + ", ".join(f"`{name}` array<struct<{nested(ddl)}>>" for name, ddl in TABLES.items())


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def confidence_number(name: Column) -> Column:
    """0 to 3; min and max of the number are the confidence algebra."""
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.lower(name)).cast("int") - 1
