"""Tables of a code graph, as DDL. Identity: symbol ids may repeat; seq orders rows where order decides."""

from __future__ import annotations

# Fixed values of the data model.
SCHEMA_VERSION = "0.1.0"
SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "enum", "variable")
EDGE_KINDS = ("imports", "calls", "extends", "implements", "http_call", "publishes", "consumes")
CONFIDENCES = ("exact", "resolved", "inferred", "ambiguous", "none")

FILES = "repo string, abs string, rel string, ext string, content binary"
MODULES = "repo string, id string, path string, symbolCount int, loc int, neighborhood int, degree int, hub boolean, x double, y double, engine string, seq bigint"
SYMBOLS = "repo string, id string, name string, kind string, module string, line int, exported boolean, refCount int, parent string, x double, y double, engine string, seq bigint"
EDGES = "repo string, `from` string, `to` string, kind string, confidence string, seq bigint"
RAW_CALLS = "repo string, `from` string, callee string, seq bigint"
IDENTS = "repo string, engine string, name string, n bigint"

#: One graph document, as it is written to <repo>.graph.json.
GRAPH = (
    "schemaVersion string, repo string, root string, language array<string>, generatedAt string, sourceFingerprint string, commit string, refName string, dirty boolean,"
    " neighborhoodLabels map<string,string>,"
    " modules array<struct<id:string,path:string,repo:string,symbolCount:int,loc:int,neighborhood:int,degree:int,hub:boolean,x:double,y:double>>,"
    " symbols array<struct<id:string,name:string,kind:string,module:string,line:int,exported:boolean,refCount:int,parent:string,x:double,y:double>>,"
    " edges array<struct<`from`:string,`to`:string,kind:string,confidence:string>>"
)
