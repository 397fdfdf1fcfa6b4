"""Python sources to tables: module facts and full-tree facts, parsed on the executors."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

FACTS = "imports array<string>, symbols array<struct<kind: string, name: string, lineno: int>>, main_guard boolean, ast_error string"
TREE = (
    "functions array<struct<name: string, qualname: string, lineno: int>>, classes array<struct<name: string, qualname: string, lineno: int>>, "
    "imports array<struct<module: string, alias: string, lineno: int>>, calls array<struct<caller: string, callee: string, lineno: int>>, config_references array<string>, ast_error string"
)


#: Label of sources that are nested too deeply for a syntax tree; they are read by their tokens.
TOO_DEEP = "too_deep"


def _parse(content: bytes | None):
    """A module and an error label: a file without code is empty_file, a broken one
    syntax_error with line and column, one that the parser has no stack or memory for too_deep."""
    text = (content or b"").decode("utf-8", "replace")
    if not text.strip():
        return None, "empty_file"
    try:
        return ast.parse(text), ""
    except SyntaxError as e:
        return None, f"syntax_error:{e.lineno or 0}:{e.offset or 0}"
    except ValueError:
        return None, "syntax_error:0:0"
    except (RecursionError, MemoryError):
        return None, TOO_DEEP


def _imported(node: ast.AST) -> list[tuple[str, str]]:
    if isinstance(node, ast.Import):
        return [(a.name, a.asname or "") for a in node.names]
    if isinstance(node, ast.ImportFrom):
        # Dots in front stand for a relative import; the importing module resolves them.
        base = "." * (node.level or 0) + (f"{node.module}." if node.module else "")
        return [(base + a.name, a.asname or "") for a in node.names]
    return []


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ".".join(parts[::-1])


def _is_main_guard(test: ast.AST) -> bool:
    said = [str(x) for node in ast.walk(test) for x in (getattr(node, "id", ""), getattr(node, "attr", ""), getattr(node, "value", "")) if isinstance(x, str)]
    return all(any(w in x for x in said) for w in ("__name__", "__main__"))


def _logical_lines(content: bytes | None) -> Iterator[tuple[int, list[tokenize.TokenInfo]]]:
    """Depth of indentation and tokens of each logical line, as far as the source has tokens; a
    line's statements that semicolons part come one by one."""
    depth, line = 0, []
    source = io.StringIO((content or b"").decode("utf-8", "replace"))
    try:
        for t in tokenize.generate_tokens(source.readline):
            if t.type == tokenize.INDENT:
                depth += 1
            elif t.type == tokenize.DEDENT:
                depth -= 1
            elif t.type == tokenize.NEWLINE or t.type == tokenize.OP and t.string == ";":
                yield depth, line
                line = []
            elif t.type not in (tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER):
                line.append(t)
    except (SyntaxError, tokenize.TokenError, RecursionError, MemoryError):
        pass  # what stands before it counts
    if line:
        yield depth, line


def _imports_of(line: list[tokenize.TokenInfo]) -> list[tuple[str, str]]:
    """Imported names and aliases of an import statement's tokens."""
    words = [t.string for t in line if t.string not in "()"]
    base, at = "", 1
    if words[0] == "from":
        if "import" not in words:
            return []
        at = words.index("import") + 1
        module = "".join(words[1 : at - 1])
        base = module if not module or module.endswith(".") else f"{module}."
    elif words[0] != "import":
        return []
    out, part = [], []
    for w in [*words[at:], ","]:
        if w != ",":
            part.append(w)
            continue
        name, _, alias = " ".join(part).partition(" as ")
        if name:
            out.append((base + name.replace(" ", ""), alias))
        part = []
    return out


def _definition(line: list[tokenize.TokenInfo]) -> tuple[str, tokenize.TokenInfo] | None:
    """Kind and name token of a def or class statement."""
    words = line[1:] if line[0].string == "async" else line
    if words and words[0].string in ("def", "class") and len(words) > 1:
        return "class" if words[0].string == "class" else "function", words[1]
    return None


def _calls_of(line: list[tokenize.TokenInfo]) -> Iterator[tuple[str, int, str | None]]:
    """Dotted names before an opening parenthesis, their line, and a literal first argument."""
    name: list[str] = []
    at = 0
    defined = _definition(line)
    for i, t in enumerate(line):
        if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
            dotted = bool(name) and line[i - 1].string == "."
            name, at = [*name, t.string] if dotted else [t.string], at if dotted else t.start[0]
        elif t.string == "(" and name and not (defined and line[i - 1] is defined[1]):
            after = [x for x in line[i + 1 : i + 3]]
            text = after[0].string if len(after) == 2 and after[0].type == tokenize.STRING and after[1].string in (",", ")") else None
            yield ".".join(name), at, text
            name = []
        elif t.string != ".":
            name = []


def _module_facts_by_tokens(content: bytes | None, out: dict) -> None:
    for depth, line in _logical_lines(content):
        if depth or not line:
            continue
        out["imports"] += [m for m, _ in _imports_of(line)]
        if found := _definition(line):
            out["symbols"].append({"kind": found[0], "name": found[1].string, "lineno": line[0].start[0]})
        said = " ".join(t.string for t in line) if line[0].string == "if" else ""
        out["main_guard"] |= "__name__" in said and "__main__" in said


def _tree_facts_by_tokens(content: bytes | None, out: dict) -> None:
    scope: list[tuple[int, str]] = []
    decorators: list[list[tokenize.TokenInfo]] = []
    for depth, line in _logical_lines(content):
        while scope and scope[-1][0] >= depth:
            scope.pop()
        if not line:
            continue
        if line[0].string == "@":
            decorators.append(line)
            continue
        for module, alias in _imports_of(line):
            out["imports"].append({"module": module, "alias": alias, "lineno": line[0].start[0]})
        # What a definition's decorators and its own line call, it calls.
        if found := _definition(line):
            scope.append((depth, found[1].string))
            out["classes" if found[0] == "class" else "functions"].append({"name": found[1].string, "qualname": ".".join(n for _, n in scope), "lineno": line[0].start[0]})
        for callee, at, text in (c for x in [*decorators, line] for c in _calls_of(x)):
            out["calls"].append({"caller": ".".join(n for _, n in scope) or "<module>", "callee": callee, "lineno": at})
            if text and callee.split(".")[-1].endswith("open"):
                value = ast.literal_eval(text)
                out["config_references"] += [value] if isinstance(value, str) else []
        decorators = []


def _module_facts(content: bytes | None) -> dict:
    tree, error = _parse(content)
    out: dict = {"imports": [], "symbols": [], "main_guard": False, "ast_error": error}
    if error == TOO_DEEP:
        _module_facts_by_tokens(content, out)
    for node in tree.body if tree else []:
        out["imports"] += [m for m, _ in _imported(node)]
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out["symbols"].append({"kind": "class" if isinstance(node, ast.ClassDef) else "function", "name": node.name, "lineno": node.lineno})
        if isinstance(node, ast.If) and _is_main_guard(node.test):
            out["main_guard"] = True
    return out


def _tree_facts(content: bytes | None) -> dict:
    tree, error = _parse(content)
    out: dict = {"functions": [], "classes": [], "imports": [], "calls": [], "config_references": [], "ast_error": error}
    if error == TOO_DEEP:
        _tree_facts_by_tokens(content, out)
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())] if tree else []
    while todo:
        node, scope = todo.pop()
        inner = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = (*scope, node.name)
            out["classes" if isinstance(node, ast.ClassDef) else "functions"].append({"name": node.name, "qualname": ".".join(inner), "lineno": node.lineno})
        elif isinstance(node, ast.Call):
            callee = _dotted(node.func)
            if callee:
                out["calls"].append({"caller": ".".join(scope) or "<module>", "callee": callee, "lineno": node.lineno})
            first = node.args[0] if node.args else None
            if callee.split(".")[-1].endswith("open") and isinstance(first, ast.Constant) and isinstance(first.value, str):
                out["config_references"].append(first.value)
        else:
            out["imports"] += [{"module": m, "alias": a, "lineno": node.lineno} for m, a in _imported(node)]
        todo += [(c, inner) for c in ast.iter_child_nodes(node)]
    for k, order in (("functions", "lineno"), ("classes", "lineno"), ("imports", "lineno"), ("calls", "lineno")):
        out[k].sort(key=lambda x: (x[order], *map(str, x.values())))
    out["config_references"] = sorted(set(out["config_references"]))
    return out


def _facts_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for contents in batches:
        yield pd.DataFrame([_module_facts(c) for c in contents], columns=["imports", "symbols", "main_guard", "ast_error"])


def _trees_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for contents in batches:
        yield pd.DataFrame([_tree_facts(c) for c in contents], columns=["functions", "classes", "imports", "calls", "config_references", "ast_error"])


def module_facts(content: Column) -> Column:
    """Top-level imports, symbols, main guard and error of a Python source."""
    return F.pandas_udf(_facts_of, FACTS)(content)


def analyze(files: DataFrame) -> DataFrame:
    """files (path, content) -> file_path and full-tree facts, one row a Python file."""
    ship(files.sparkSession)
    return files.where(F.lower("path").endswith(".py")).select(F.col("path").alias("file_path"), F.pandas_udf(_trees_of, TREE)("content").alias("t")).select("file_path", "t.*")
