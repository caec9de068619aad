"""Table schemas and fixed values of the symbol index."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the behaviour being reproduced) ---------------
# Symbol kinds, in declaration order.
SYMBOL_TYPES = ("function", "class", "method", "property", "interface", "type", "route", "variable")
# Ranking priority per kind; any other kind ranks 999.
TYPE_PRIORITY = {
    "function": 1,
    "class": 2,
    "route": 3,
    "method": 4,
    "interface": 5,
    "type": 6,
    "property": 7,
    "variable": 8,
}
OTHER_TYPE_PRIORITY = 999
# Default listing patterns of a full scan and of the usage scan.
DEFAULT_PATTERNS = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx")
# Extension -> extractor language; first registered wins.
LANGUAGE_BY_EXTENSION = (
    (("ts", "tsx"), "ts"),
    (("js", "jsx"), "js"),
    (("py",), "py"),
)
# Default result sizes.
SEARCH_LIMIT = 20
AUTOCOMPLETE_LIMIT = 10
USAGE_LIMIT = 50
CHILD_SCAN_LIMIT = 50
# Snippet lines are joined by a backslash followed by the letter n.
SNIPPET_SEPARATOR = "\\n"
# ---------------------------------------------------------------------------

METADATA = T.StructType(
    [
        T.StructField("is_component", T.BooleanType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("route_method", T.StringType()),
        T.StructField("route_path", T.StringType()),
        T.StructField("handler", T.StringType()),
    ]
)

SYMBOLS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("parent_symbol", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)

FILE_TRACKING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("last_parsed", T.TimestampType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("exists", T.BooleanType()),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.TimestampType()),
    ]
)

SYMBOL_KEY = ("symbol", "type", "file", "parent_symbol")

# Nested file documentation (one struct per file) and its parts.
FUNC_T = "struct<name:string,params:array<string>,return_type:string,description:string,exported:boolean>"
METHOD_T = "struct<name:string,params:array<string>,return_type:string,description:string,visibility:string>"
PROP_T = "struct<name:string,type:string,description:string,visibility:string>"
CLASS_T = (f"struct<name:string,description:string,exported:boolean,is_component:boolean,"
           f"methods:array<{METHOD_T}>,properties:array<{PROP_T}>>")
IFACE_T = f"struct<name:string,description:string,exported:boolean,properties:array<{PROP_T}>,methods:array<{METHOD_T}>>"
ALIAS_T = "struct<name:string,type:string,description:string,exported:boolean>"
ROUTE_T = "struct<method:string,path:string,handler:string,description:string>"
DOC_T = (f"struct<functions:array<{FUNC_T}>,classes:array<{CLASS_T}>,interfaces:array<{IFACE_T}>,"
         f"type_aliases:array<{ALIAS_T}>,routes:array<{ROUTE_T}>>")

#: Hint of the joins that answer batches of requests: there are many in one plan, and a broadcast side, however small, holds
#: a whole memory page of the driver (up to 64 MB) while the plan lives.  Joins with the files or a gram index go without it.
APART = "merge"
