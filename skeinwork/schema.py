"""Columns of the package's tables, as DDL."""

NODES = "key long, id string, kind string, name string, filepath string, start_line int, end_line int, source_text string, docstring string, signature string, parent_id string, repo_id string"
EDGES = "src long, dst long, relation string"
RECORDS = "rec_type string, seq int, id string, kind string, name string, filepath string, start_line int, end_line int, source_text string, docstring string, signature string, parent_id string, source_id string, target_id string, relation string"
KINDS = ("module", "class", "function", "method", "import", "variable", "decorator", "argument")
RELATIONS = ("contains", "calls", "imports", "inherits", "decorates")
