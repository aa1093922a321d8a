"""Source files to symbols and relations: one file row becomes many records.

Python is parsed by its own ast. Other languages are read by a table of line patterns and brace depth, as no grammar library is
at hand: declarations with their extent and the comment above them, decorators, variables, imports, inheritance and calls are found, expressions
aren't parsed; what stands in comments and strings isn't read as code. A file that can't be parsed gives no records, and a language
without a parser none either.
"""

from __future__ import annotations

import ast
import copy
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.docs import import_links
from skeinwork.schema import RECORDS
from skeinwork.sources.files import LANGUAGES

SOURCE_LIMIT = 2000
MOST_BYTES = 1 << 20
#: Files that a task parses, about, and records of a batch that it gives, about.
TASK_FILES, BATCH_ROWS = 1000, 2000


class Records:
    """Collects records of a file: of a node id the first stays, of an edge one, and none from a node to itself unless loops are wanted."""

    def __init__(self, repo: str, path: str, loops: bool = False):
        self.repo, self.path, self.loops = repo, path, loops
        self.nodes: dict[str, dict] = {}
        self.edges: dict[tuple[str, str, str], None] = {}

    def id(self, kind: str, name: str) -> str:
        return f"{self.repo}:{self.path}:{kind}:{name}"

    def node(self, kind: str, name: str, start: int, end: int, source: str, parent: str | None = None, docstring: str | None = None, signature: str | None = None) -> str:
        i = self.id(kind, name)
        self.nodes.setdefault(i, {"id": i, "kind": kind, "name": name, "filepath": self.path, "start_line": start, "end_line": end, "source_text": source[:SOURCE_LIMIT], "docstring": docstring, "signature": signature, "parent_id": parent})
        if parent:
            self.edge(parent, i, "contains")
        return i

    def edge(self, source: str, target: str, relation: str) -> None:
        if source != target or self.loops:
            self.edges.setdefault((source, target, relation))

    def rows(self) -> list[dict]:
        found = [{"rec_type": "node", **n} for n in self.nodes.values()] + [{"rec_type": "edge", "source_id": s, "target_id": t, "relation": r} for s, t, r in self.edges]
        return [{"seq": k, **row} for k, row in enumerate(found)]


def dotted(node: ast.AST) -> str | None:
    """The name that an expression ends in: of a.b.c it is c, of f(x) it is f."""
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """def line without its body; defaults are shown as `...`."""
    shown = copy.copy(node.args)
    shown.defaults = [ast.Constant(...) for _ in shown.defaults]
    shown.kw_defaults = [d and ast.Constant(...) for d in shown.kw_defaults]
    head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{head} {node.name}({ast.unparse(shown)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")


def parse_python(path: str, source: str, repo: str) -> list[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = Records(repo, path)
    lines = [x.encode() for x in LINE.findall(source)]

    def text(n: ast.AST) -> str:
        """As ast.get_source_segment(), which cuts the source into lines for each node."""
        found = lines[n.lineno - 1 : n.end_lineno]
        found[-1] = found[-1][: n.end_col_offset]
        found[0] = found[0][n.col_offset :]
        return b"".join(found).decode()

    stem = path.rsplit("/", 1)[-1].removesuffix(".py")
    module = out.node("module", stem, 1, source.count("\n") + 1, source, docstring=ast.get_docstring(tree))

    def decorated(node, owner: str) -> None:
        for d in node.decorator_list:
            if name := dotted(d):
                i = out.node("decorator", name, d.lineno, d.end_lineno, text(d), module)
                out.edge(i, owner, "decorates")

    def visit(body: list[ast.AST], parent: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                i = out.node("class", n.name, n.lineno, n.end_lineno, text(n), parent, ast.get_docstring(n))
                for b in n.bases:
                    if name := dotted(b):
                        out.edge(i, out.id("class", name), "inherits")
                decorated(n, i)
                visit(n.body, i, True)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                i = out.node("method" if in_class else "function", n.name, n.lineno, n.end_lineno, text(n), parent, ast.get_docstring(n), signature(n))
                for c in ast.walk(n):
                    if isinstance(c, ast.Call) and (name := dotted(c.func)) and name != n.name:
                        out.edge(i, out.id("function", name), "calls")
                decorated(n, i)
                visit(n.body, i, in_class)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                base = f"{n.module}." if isinstance(n, ast.ImportFrom) and n.module else ""
                for a in n.names:
                    i = out.node("import", a.asname or a.name, n.lineno, n.end_lineno, text(n), module, base + a.name if base else None)
                    out.edge(module, i, "imports")
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(target, ast.Name):  # neither self.x nor a[i] nor a, b
                        out.node("variable", target.id, n.lineno, n.end_lineno, text(n), parent)
            else:
                for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                    visit([x for h in getattr(n, part, []) or [] for x in (h.body if isinstance(h, (ast.ExceptHandler, ast.match_case)) else [h])], parent, in_class)

    visit(tree.body, module, False)
    return out.rows()


NAME = r"([A-Za-z_$][\w$]*)"
#: language: (classes, functions, imports, end of a comment's marker).
GRAMMARS: dict[str, tuple[str, str, str]] = {
    "typescript": (rf"\b(?:class|interface|enum)\s+{NAME}", rf"\bfunction\s*\*?\s+{NAME}|\b(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*(?::[^=]+)?=>|^\s+(?:async\s+|static\s+|public\s+|private\s+)*{NAME}\([^)]*\)\s*(?::[^{{]+)?{{", r"\bimport\s.*?from\s+['\"]([^'\"]+)|\bimport\s+['\"]([^'\"]+)|require\(['\"]([^'\"]+)"),
    "go": (rf"\btype\s+{NAME}\s+(?:struct|interface)", rf"^func\s+(?:\([^)]*\)\s*)?{NAME}\s*\(", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "rust": (rf"\b(?:struct|enum|trait)\s+{NAME}", rf"\bfn\s+{NAME}", r"\buse\s+([\w:]+)"),
    "java": (rf"\b(?:class|interface|enum|record)\s+{NAME}", rf"^\s+(?:[\w<>\[\],.@]+\s+)+{NAME}\s*\([^;]*$", r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    "csharp": (rf"\b(?:class|interface|struct|enum|record)\s+{NAME}", rf"^\s+(?:[\w<>\[\],.?]+\s+)+{NAME}\s*\([^;]*$", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    "kotlin": (rf"\b(?:class|interface|object)\s+{NAME}", rf"\bfun\s+(?:<[^>]+>\s*)?(?:\w+\.)?{NAME}", r"^\s*import\s+([\w.]+)"),
    "ruby": (rf"^\s*(?:class|module)\s+{NAME}", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"),
    "php": (rf"\b(?:class|interface|trait)\s+{NAME}", rf"\bfunction\s+&?{NAME}", r"^\s*use\s+([\w\\]+)"),
    "swift": (rf"\b(?:class|struct|enum|protocol)\s+{NAME}", rf"\bfunc\s+{NAME}", r"^\s*import\s+(\w+)"),
    "cpp": (rf"\b(?:class|struct|enum(?:\s+class)?)\s+{NAME}\s*(?:final\s*)?[:{{]", rf"^[\w:<>*&~\s]*?\b(?:\w+::)*(~?[A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?{{?\s*$", r"^\s*#\s*include\s+[<\"]([^>\"]+)"),
}
#: What declares a variable.
VARIABLES: dict[str, str] = {
    "typescript": rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=",
    "go": rf"^\s*(?:var|const)\s+{NAME}\b",
    "rust": rf"^\s*(?:pub\s+)?(?:static|const|let)\s+(?:mut\s+)?{NAME}\s*[:=]",
    "java": rf"^\s+(?:(?:private|public|protected|static|final|volatile)\s+)+[\w<>\[\],.?]+\s+{NAME}\s*[=;]",
    "csharp": rf"^\s+(?:(?:private|public|protected|internal|static|readonly|const)\s+)+[\w<>\[\],.?]+\s+{NAME}\s*[=;]",
    "kotlin": rf"\b(?:val|var)\s+{NAME}\s*[:=]",
    "ruby": r"(?!)",
    "php": rf"^\s+(?:(?:public|private|protected|static|const|readonly)\s+)+(?:\??\w+\s+)?\$?{NAME}\s*[=;]",
    "swift": rf"\b(?:let|var)\s+{NAME}\s*[:=]",
    "cpp": r"(?!)",
}
DECORATOR = re.compile(r"^\s*@([A-Za-z_][\w.]*)")
INHERITS = re.compile(r"\b(?:extends|implements)\s+([\w$.,\s]+?)\s*(?:\{|$|implements)|^\s*(?:public\s+|abstract\s+|final\s+|open\s+|data\s+)*(?:class|struct|interface)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*(?::|<)\s*([\w$.,\s:()]+?)\s*(?:\{|$)")
CALL = re.compile(r"(?:^|[^\w.])(?:[\w$]+\.)*([A-Za-z_$][\w$]*)\s*\(")
WORDS = frozenset("if for while switch catch return function def fn func fun new sizeof match when foreach elseif typeof super constructor".split())
STRING = r'"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`'
#: What isn't code: strings (group 1) and comments (group 2).
TEXTS = {
    "rust": re.compile(rf"({STRING}|'(?:\\.|[^'\\])')|(/\*[\s\S]*?\*/|//[^\n]*)"),
    "ruby": re.compile(rf"({STRING}|'(?:\\.|[^'\\\n])*')|((?m:^=begin[\s\S]*?^=end)|#[^\n]*)"),
    "php": re.compile(rf"({STRING}|'(?:\\.|[^'\\\n])*')|(/\*[\s\S]*?\*/|//[^\n]*|#[^\n]*)"),
}
OTHER_TEXTS = re.compile(rf"({STRING}|'(?:\\.|[^'\\\n])*')|(/\*[\s\S]*?\*/|//[^\n]*)")
BLOCK = re.compile(r"\s*(?:class|module|def|if|unless|while|until|case|begin)\b|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def without_texts(source: str, language: str) -> tuple[list[str], list[str], dict[int, str]]:
    """Lines without comments, lines without comments and strings' insides, and the comments by their last line."""
    comments: dict[int, str] = {}

    def blank(m: re.Match, strings: bool) -> str:
        if m[1] is not None:
            return m[1][0] + re.sub(r"[^\n]", " ", m[1][1:-1]) + m[1][-1] if strings else m[1]
        if strings:
            comments[source.count("\n", 0, m.end())] = m[2]
        return re.sub(r"[^\n]", " ", m[2])

    pattern = TEXTS.get(language, OTHER_TEXTS)
    code, bare = (pattern.sub(lambda m, s=s: blank(m, s), source).split("\n") for s in (False, True))
    return code, bare, comments


def parse_lines(language: str) -> Callable[[str, str, str], list[dict]]:
    classes, functions, imports = (re.compile(x) for x in GRAMMARS[language])
    variables, ruby = re.compile(VARIABLES[language]), language == "ruby"
    first = lambda m: next((g for g in m.groups() if g), None)

    def comment_above(comments: dict[int, str], code: list[str], k: int) -> str | None:
        """The comment that ends right above line k (decorators aside), with the line comments above it."""
        k -= 1
        while k >= 0 and DECORATOR.match(code[k]):
            k -= 1
        found = []
        while k in comments and not code[k].strip():
            found.append(comments[k])
            k -= comments[k].count("\n") + 1
            if found[-1].startswith("/*"):
                break
        return "\n".join(x.strip() for x in reversed(found)) or None

    def has_body(bare: list[str], k: int, after: int) -> bool:
        rest = " ".join([bare[k][after:], *bare[k + 1 : k + 10]])
        opens, ends = rest.find("{"), rest.find(";")
        expression = re.match(r"[^{;]*?\)?\s*(?::\s*[\w<>?.]+\s*)?=(?![=>])", rest.split("{")[0])
        return opens >= 0 and not 0 <= ends < opens and not (expression and language in ("kotlin", "swift"))

    def parse(path: str, source: str, repo: str) -> list[dict]:
        if len(source) > MOST_BYTES:
            return []
        out, rows = Records(repo, path, loops=True), source.split("\n")
        code, bare_rows, comments = without_texts(source, language)
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        module = out.node("module", stem, 1, max(1, len(source.splitlines())), source)
        scopes: list[tuple[int, str, str, int]] = []  # depth at which a scope began, kind, id, line
        decorators: list[tuple[str, int]] = []
        depth = 0

        def declared(kind: str, name: str, k: int, parent: str, body: bool) -> str:
            known = out.id(kind, name) in out.nodes
            i = out.node(kind, name, k + 1, k + 1, rows[k], parent, comment_above(comments, code, k), rows[k].strip())
            for d, at in decorators:
                out.edge(out.node("decorator", d, at + 1, at + 1, rows[at].strip()), i, "decorates")
            decorators.clear()
            if body:
                scopes.append((depth, kind, i if not known else "", k))
            return i

        def closed(k: int) -> None:
            _, _, i, start = scopes.pop()
            if i:
                out.nodes[i].update(end_line=k + 1, source_text="\n".join(rows[start : k + 1])[:SOURCE_LIMIT])

        for k, bare in enumerate(bare_rows):
            if m := DECORATOR.match(bare):
                decorators.append((m[1].rsplit(".", 1)[-1], k))
                bare = bare[m.end() :]
            inside = next((True for s in reversed(scopes) if s[1] == "class"), False)
            parent = next((s[2] for s in reversed(scopes) if s[2]), module)
            caller = next((s[2] for s in reversed(scopes) if s[1] in ("function", "method")), "")
            if (m := imports.search(code[k])) and bare.strip():
                i = out.node("import", first(m), k + 1, k + 1, code[k].strip(), parent)
                out.edge(i, i, "imports")
            elif m := classes.search(bare):
                i = declared("class", m[1], k, parent, ruby or has_body(bare_rows, k, m.end()))
                if h := INHERITS.search(bare):
                    for base in re.split(r"[,\s]+", first(h) or ""):
                        if base and base.isidentifier() and base not in ("public", "private", "protected", "virtual", "implements"):
                            out.edge(i, out.id("class", base), "inherits")
            elif (m := functions.search(bare)) and first(m) not in WORDS:
                body = ruby or has_body(bare_rows, k, m.end() - (bare[: m.end()].endswith("{")))
                i = declared("method" if inside else "function", first(m), k, parent, body)
                _, opened, rest = bare.partition("{" if "{" in bare else "=>")
                for name in CALL.findall(rest) if opened else ():
                    if name not in WORDS:
                        out.edge(i, out.id("function", name), "calls")
            else:
                if m := variables.search(bare):
                    out.node("variable", first(m), k + 1, k + 1, rows[k].strip(), parent, comment_above(comments, code, k), rows[k].strip())
                for name in CALL.findall(bare) if caller else ():
                    if name not in WORDS:
                        out.edge(caller, out.id("function", name), "calls")
            if bare.strip() and not DECORATOR.match(bare_rows[k]):
                decorators.clear()
            if ruby:
                ends = bool(re.match(r"\s*end\b", bare))
                depth += bool(BLOCK.match(bare)) - ends
            else:
                ends = "}" in bare
                depth += bare.count("{") - bare.count("}")
            while scopes and ends and depth <= scopes[-1][0]:
                closed(k)
        while scopes:
            closed(len(rows) - 1)
        return out.rows()

    return parse


Parser = Callable[[str, str, str], list[dict]]
PARSERS: dict[str, Parser] = {"python": parse_python} | {name: parse_lines(name) for name in GRAMMARS}


class Registry:
    """Parsers by language, and languages by extension. After freeze() nothing can be added."""

    def __init__(self):
        self.parsers: dict[str, Parser] = {}
        self.languages: dict[str, str] = {}
        self.frozen = False

    def register(self, language: str, extensions: tuple[str, ...], parser: Parser) -> None:
        if self.frozen:
            raise RuntimeError("the registry is frozen")
        for e in map(str.lower, extensions):
            if e in self.languages:
                raise ValueError(f"{e} belongs to {self.languages[e]} already")
            self.languages[e] = language
        self.parsers[language] = parser

    def freeze(self) -> Registry:
        self.frozen = True
        return self

    def parser(self, path: str) -> Parser | None:
        """The parser of a path's extension, in any case; None for others."""
        dot = path.rfind(".", path.rfind("/") + 1)
        return self.parsers.get(self.languages.get(path[dot:].lower(), "")) if dot >= 0 else None


def default_registry() -> Registry:
    """All languages, frozen."""
    out = Registry()
    for language, parser in PARSERS.items():
        out.register(language, tuple(e for e, name in LANGUAGES.items() if name == language), parser)
    return out.freeze()


def parse_files(files: DataFrame, repo: str, registry: Registry | None = None) -> DataFrame:
    """Records of source files. files: filepath, language, source. registry: other parsers than the package's."""
    parsers = registry.parsers if registry else PARSERS
    kinds = {"int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in RECORDS.split(", "))])

    def records(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name) for row in found], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for path, language, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held += parsers[language](path, source or "", repo) if language in parsers else []
                if len(held) >= BATCH_ROWS:
                    yield records(held)
                    held = []
            if held:
                yield records(held)

    some = files.select("filepath", "language", "source")
    if not files.isStreaming:  # parsing is dear, and few bytes may hold many files
        some = some.repartition(max(1, -(-files.count() // TASK_FILES)))
    return some.mapInArrow(run, RECORDS)


def parse_repository(files: DataFrame, repo: str, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a repository's files, with the links of its imports to what they name in other files."""
    records = parse_files(files, repo, registry)
    nodes = records.where("rec_type = 'node'").select("id", "kind", "name", "filepath", "start_line", "end_line", "source_text", "docstring", "signature", "parent_id")
    imports = nodes.where("kind = 'import'").select("id", F.coalesce("docstring", "name").alias("target"))
    links = import_links(imports, nodes.select("id", "name", "kind")).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("imports").alias("relation"))
    edges = records.where("rec_type = 'edge'").select("source_id", "target_id", "relation")
    return nodes, edges.union(links).distinct()
