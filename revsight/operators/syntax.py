"""Python source as a table of syntax nodes, and rules over that table as one projection.

One small helper parses each file once and lists its nodes in order.  A node carries what rules ask of its surroundings:
facts of its parent, of the call it is an argument of, of the sibling before it, and counts of what lies inside it.  So
every rule is a condition on one row, and all rules together are one pass without a join, a group or a shuffle.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language
from .rules import FIXES

NODES = (
    "node int, parent int, field string, idx int, kind string, line int, end_line int, name string, value string, value_type string, op string, names array<string>, size int, doc string, depth int, "
    # the parent, its parent, the call whose argument this is, the sibling before
    "above_kind string, above_op string, above_name string, above_line int, above_size int, above_depth int, owner_kind string, owner_line int, callee string, callee_kind string, callee_line int, before_kind string, "
    # of an assignment's target: what is assigned
    "given_kind string, given_type string, given_call string, given_chars int, "
    # of a definition or a loop: what is inside
    "parts array<string>, decisions int, plain_decisions int, methods int, appends int, grows int, unused array<string>, returns string, body string, "
    # of every node: how many nodes it is with all below, its shape and its parent's
    "nodes int, shape long, above_shape long"
)
_FIELDS = [p.rsplit(" ", 1) for p in NODES.split(", ")]
_AT = {name: i for i, (name, _) in enumerate(_FIELDS)}
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
#: Nodes that one Arrow batch holds, of however many files; a worker keeps no more of them as Python objects.
BATCH = 5_000

#: Nodes that make what is inside them one level deeper.
CONTROL = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.TryStar, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp)
#: Nodes that add a way through a function.
DECISIONS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.comprehension)
_SKIPPED = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
_DEFINED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Levels of control flow that are not too deep.
DEPTH = 10


def _text(value: object) -> str:
    """A constant as text that any table can hold."""
    try:
        out = str(value)
    except ValueError:  # a number of very many digits
        out = hex(value)  # type: ignore[arg-type]
    return out.encode("utf-8", "replace").decode()


def _own(node: ast.AST, row: list) -> None:
    """What a node says about itself."""
    row[_AT["name"]] = next((getattr(node, a) for a in ("name", "id", "attr", "arg", "module") if isinstance(getattr(node, a, None), str)), None)
    if isinstance(node, ast.Constant):
        row[_AT["value"]], row[_AT["value_type"]] = _text(node.value), type(node.value).__name__
    elif isinstance(node, ast.Name):
        row[_AT["op"]] = type(node.ctx).__name__
    elif isinstance(node, ast.Compare):
        row[_AT["op"]] = ",".join(type(o).__name__ for o in node.ops)
    elif hasattr(node, "op"):
        row[_AT["op"]] = type(node.op).__name__
        if isinstance(node, ast.BoolOp):
            row[_AT["size"]] = len(node.values)
    elif isinstance(node, (ast.Global, ast.Nonlocal)):
        row[_AT["names"]] = list(node.names)
    elif isinstance(node, ast.alias):
        row[_AT["value"]] = node.asname
    elif isinstance(node, ast.ExceptHandler):
        row[_AT["size"]], row[_AT["op"]] = len(node.body), "bare" if node.type is None else "typed"
    elif isinstance(node, _DEFINED):
        doc = ast.get_docstring(node)
        row[_AT["doc"]] = None if doc is None else _text(doc)
        if isinstance(node, ast.ClassDef):
            own = [x for x in node.body if isinstance(x, ast.FunctionDef)]
            row[_AT["parts"]], row[_AT["methods"]] = [x.name for x in own], len(own)
        else:
            row[_AT["size"]], row[_AT["parts"]] = len(node.args.args), [a.arg for a in node.args.args]
            row[_AT["returns"]] = None if node.returns is None else _text(ast.unparse(node.returns))


def _around(field: str, parent: ast.AST, above: list, grand: ast.AST | None, owner: list | None, call: tuple | None, row: list) -> None:
    """What a node knows of what is around it: rows of its parent and of that one's parent, and the call it is passed to."""
    for c, of in (("above_kind", "kind"), ("above_op", "op"), ("above_name", "name"), ("above_line", "line"), ("above_size", "size"), ("above_depth", "depth")):
        row[_AT[c]] = above[_AT[of]]
    if owner is not None:
        row[_AT["owner_kind"]], row[_AT["owner_line"]] = owner[_AT["kind"]], owner[_AT["line"]]
    if call is not None:
        row[_AT["callee"]], row[_AT["callee_kind"]], row[_AT["callee_line"]] = call
    if field == "targets" and isinstance(parent, ast.Assign):
        given = parent.value
        row[_AT["given_kind"]] = type(given).__name__
        if isinstance(given, ast.Constant):
            row[_AT["given_type"]] = type(given.value).__name__
            row[_AT["given_chars"]] = len(given.value) if isinstance(given.value, str) else None
        elif isinstance(given, ast.Call) and isinstance(given.func, ast.Name):
            row[_AT["given_call"]] = given.func.id


def _called(node: ast.AST, line: int | None) -> tuple | None:
    """Name, kind and line of what a call calls."""
    if not isinstance(node, ast.Call):
        return None
    f = node.func
    return getattr(f, "id", getattr(f, "attr", None)), type(f).__name__, getattr(f, "lineno", line)


def listed(source: str, bodies: bool = False) -> list[list]:
    """The nodes of a source text, parents before children; one node of kind SyntaxError if it can't be parsed."""
    width = len(_FIELDS)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        row = [None] * width
        row[:11] = [0, -1, "", 0, "SyntaxError", getattr(e, "lineno", None) or 1, None, None, _text(e), None, None]
        row[_AT["size"]] = row[_AT["depth"]] = 0
        return [row]
    lines = source.splitlines() if bodies else []
    rows: list[list] = []
    names: dict[int, tuple[dict[str, None], set[str]]] = {}  # names that a function assigns, and reads
    # node, its parent and grandparent with their rows, field, place, sibling before, functions and loops around, line, depth
    waiting: list[tuple] = [(tree, None, None, None, None, "", 0, None, (), (), None, 0)]
    while waiting:
        node, parent, above, grand, owner, field, idx, before, functions, loops, line, depth = waiting.pop()
        line = getattr(node, "lineno", line)
        here, row = len(rows), [None] * width
        rows.append(row)
        kind = type(node).__name__
        row[:7] = [here, -1 if above is None else above[0], field, idx, kind, line, getattr(node, "end_lineno", line)]
        row[_AT["size"]] = 0
        row[_AT["depth"]] = depth
        row[_AT["before_kind"]] = before
        _own(node, row)
        if above is not None:
            passed = _called(parent, above[_AT["line"]]) if field == "args" else _called(grand, line) if isinstance(parent, ast.keyword) else None
            _around(field, parent, above, grand, owner, passed, row)
        # counts of what lies inside, on the functions and loops around
        plain = weight = int(isinstance(node, DECISIONS))
        if isinstance(node, ast.BoolOp):
            plain, weight = 1, len(node.values) - 1
        elif isinstance(node, ast.Assert):
            weight = 1
        if weight or plain:
            for f in functions:
                rows[f][_AT["decisions"]] += weight
                rows[f][_AT["plain_decisions"]] += plain
        if isinstance(node, ast.Name):
            for f in functions:
                if isinstance(node.ctx, ast.Load):
                    names[f][1].add(node.id)
                elif field == "targets" and isinstance(parent, ast.Assign):
                    names[f][0][node.id] = None
        elif isinstance(node, ast.Attribute) and field == "func" and node.attr == "append":
            for f in loops:
                rows[f][_AT["appends"]] += 1
        elif isinstance(node, ast.AugAssign) and isinstance(node.op, ast.Add) and isinstance(node.target, ast.Name):
            for f in loops:
                rows[f][_AT["grows"]] += 1
        if isinstance(node, ast.FunctionDef):
            functions = (*functions, here)
            names[here] = ({}, set())
            row[_AT["decisions"]] = row[_AT["plain_decisions"]] = 0
            if bodies:
                row[_AT["body"]] = _text("\n".join(lines[node.lineno - 1 : node.end_lineno]))
        elif isinstance(node, ast.For):
            loops = (*loops, here)
            row[_AT["appends"]] = row[_AT["grows"]] = 0
        inner = depth + isinstance(node, CONTROL)
        below = []
        for f, v in ast.iter_fields(node):
            last = None
            for i, child in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(child, ast.AST) and not isinstance(child, _SKIPPED):
                    # an elif starts in its if's column and is no deeper than that
                    elif_ = f == "orelse" and isinstance(node, ast.If) and isinstance(child, ast.If) and child.col_offset == node.col_offset
                    below.append((child, node, row, parent, above, f, i, last, functions, loops, line, depth if elif_ else inner))
                    last = type(child).__name__
        waiting += reversed(below)
    for f, (assigned, read) in names.items():
        rows[f][_AT["unused"]] = [n for n in assigned if n not in read and not n.startswith("_") and n not in ("self", "cls")]
    _shaped(rows)
    return rows


def _shaped(rows: list[list]) -> None:
    """Counts and shapes of subtrees, from the last node to the first: children come after their parents, in order."""
    below: list[list[bytes]] = [[] for _ in rows]
    sizes = [1] * len(rows)
    for row in reversed(rows):
        here = row[0]
        own = f"{row[_AT['kind']]}\0{row[_AT['op']]}\0{row[_AT['value_type']]}\0".encode()
        inside = blake2b(b"".join([own, *reversed(below[here])]), digest_size=8).digest()
        row[_AT["nodes"]], row[_AT["shape"]] = sizes[here], int.from_bytes(inside, "little", signed=True)
        if row[1] >= 0:
            sizes[row[1]] += sizes[here]
            below[row[1]].append(row[_AT["field"]].encode() + b"\0" + inside)
    for row in rows:
        if row[1] >= 0:
            row[_AT["above_shape"]] = rows[row[1]][_AT["shape"]]


def nodes(files: DataFrame, bodies: bool = False) -> DataFrame:
    """Syntax nodes of the Python files among ``files`` (path, content, ...), with the other columns of each file.

    A null text is an empty file.  ``bodies``: functions carry their source lines.
    """
    own = files.where(language("path") == "python")
    keys = [c for c in files.columns if c != "content"]
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in files.dtypes if c != "content"], NODES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            owners: list[int] = []
            for k, text in enumerate(batch.column("content")):
                new = listed(text.as_py() or "", bodies)
                rows += new
                owners += [k] * len(new)
                if rows and (len(rows) > BATCH or k == batch.num_rows - 1):
                    at = pa.array(owners, pa.int32())
                    facts = [pa.array(c, _KINDS[t]) for c, (_, t) in zip(zip(*rows), _FIELDS)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keys], *facts], names=[*keys, *[n for n, _ in _FIELDS]])
                    rows, owners = [], []

    return own.mapInArrow(run, ddl)


# Rule, severity, title.
RULES = {
    "high_complexity": ("medium", "High Cyclomatic Complexity"),
    "long_function": ("low", "Long Function"),
    "too_many_params": ("low", "Too Many Parameters"),
    "large_class": ("medium", "Large Class"),
    "long_parameter_list": ("low", "Long Parameter List"),
    "magic_number": ("low", "Magic Number"),
    "missing_docstring": ("low", "Missing Docstring"),
    "missing_class_docstring": ("low", "Missing Class Docstring"),
    "function_naming": ("low", "Naming Convention Violation"),
    "class_naming": ("low", "Class Naming Convention"),
    "mutable_default": ("high", "Mutable Default Argument"),
    "none_comparison": ("medium", "Incorrect None Comparison"),
    "bare_except": ("high", "Bare Except Clause"),
    "old_string_format": ("low", "Old-style String Formatting"),
    "inefficient_loop": ("low", "Loop Could Be List Comprehension"),
    "string_concat_loop": ("medium", "String Concatenation in Loop"),
    "global_usage": ("low", "Global Variable Usage"),
    "eval_usage": ("critical", "Dangerous eval() Usage"),
    "exec_usage": ("critical", "Dangerous exec() Usage"),
    "hardcoded_credential": ("high", "Hardcoded Credential"),
    "unreachable_code": ("medium", "Unreachable Code"),
    "unused_variable": ("low", "Unused Variable"),
    "sql_injection": ("critical", "Potential SQL Injection"),
    "path_traversal": ("high", "Potential Path Traversal"),
    "assert_in_production": ("low", "Assert Statement in Production Code"),
    "except_pass": ("medium", "Empty Exception Handler"),
    "shell_true": ("high", "Subprocess with shell=True"),
    "syntax_error": ("high", "Syntax Error"),
}
# Limits of the size rules; names that hint at a credential.
COMPLEXITY, FUNCTION_LINES, PARAMS, MANY_PARAMS, METHODS, CREDENTIAL_CHARS = 10, 50, 5, 7, 20, 8
CREDENTIAL_WORDS = ("password", "secret", "key", "token")
#: These rules come from the security scan: their issues are of its category and more certain.
SECURITY_RULES = ("assert_in_production", "except_pass", "shell_true")


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def complexity(asserts: bool = True) -> Column:
    """Cyclomatic complexity of a function node.  With ``asserts`` asserts count, and each operand of a boolean chain but one; else a chain counts once."""
    return F.col("decisions" if asserts else "plain_decisions") + 1


def conditions(helpers: bool = False) -> list[tuple[str, Column, str, Column | int]]:
    """The rules as a table (rule, condition on a node, whose line, findings of one node), in order of discovery.

    ``helpers``: with the two stand-alone checks too.
    """
    c, field, above = F.col, lambda x: F.col("field") == x, lambda x: F.col("above_kind") == x
    func, cls, name = _is("FunctionDef"), _is("ClassDef"), F.col("name")
    first = F.substring("name", 1, 1)
    hint = reduce(lambda a, b: a | b, [F.lower("name").contains(w) for w in CREDENTIAL_WORDS])
    passed = lambda kind, *names: (c("callee_kind") == kind) & c("callee").isin(*names)
    out = [
        ("syntax_error", _is("SyntaxError"), "line", 1),
        ("high_complexity", func & (complexity() > COMPLEXITY), "line", 1),
        ("long_function", func & (c("end_line") - c("line") > FUNCTION_LINES), "line", 1),
        ("too_many_params", func & (c("size") > PARAMS), "line", 1),
        ("large_class", cls & (c("methods") > METHODS), "line", 1),
        ("long_parameter_list", func & (c("size") > MANY_PARAMS), "line", 1),
        ("magic_number", _is("Constant") & c("value_type").isin("int", "float") & ~c("value").isin("0", "1", "-1", "0.0", "1.0", "-0.0"), "line", 1),
        ("missing_docstring", func & c("doc").isNull() & ~name.startswith("_"), "line", 1),
        ("missing_class_docstring", cls & c("doc").isNull(), "line", 1),
        ("function_naming", func & ~((name == F.lower(name)) & (name != F.upper(name))) & ~name.startswith("__"), "line", 1),
        ("class_naming", cls & (~((first == F.upper(first)) & (first != F.lower(first))) | name.contains("_")), "line", 1),
        ("mutable_default", field("defaults") & _is("List", "Dict", "Set") & above("arguments") & (c("owner_kind") == "FunctionDef"), "owner_line", 1),
        ("none_comparison", field("comparators") & (c("value_type") == "NoneType") & above("Compare") & F.concat(F.lit(","), "above_op", F.lit(",")).rlike(",(Eq|NotEq),"), "above_line", 1),
        ("bare_except", _is("ExceptHandler") & (c("op") == "bare"), "line", 1),
        ("old_string_format", field("left") & (c("value_type") == "str") & c("value").contains("%") & above("BinOp") & (c("above_op") == "Mod"), "above_line", 1),
        ("inefficient_loop", _is("For") & (c("appends") == 1), "line", 1),
        ("string_concat_loop", _is("For") & (c("grows") > 0), "line", 1),
        ("global_usage", _is("Global"), "line", F.size("names")),
        ("eval_usage", _is("Name") & field("func") & (name == "eval"), "line", 1),
        ("exec_usage", _is("Name") & field("func") & (name == "exec"), "line", 1),
        ("hardcoded_credential", field("targets") & _is("Name") & above("Assign") & hint & (c("given_type") == "str") & (c("given_chars") > CREDENTIAL_CHARS), "above_line", 1),
        ("unreachable_code", field("body") & ~_is("FunctionDef", "ClassDef", "If", "Try") & (c("before_kind") == "Return") & above("FunctionDef"), "line", 1),
        ("unused_variable", func, "line", F.size("unused")),
        ("assert_in_production", _is("Assert"), "line", 1),
        ("except_pass", _is("Pass") & field("body") & above("ExceptHandler") & (c("above_size") == 1), "above_line", 1),
        ("shell_true", (c("value_type") == "bool") & (c("value") == "True") & field("value") & above("keyword") & (c("above_name") == "shell") & passed("Attribute", "call", "run", "Popen"), "callee_line", 1),
    ]
    if helpers:
        plus = _is("BinOp") & (c("op") == "Add") & field("args")
        out.append(("sql_injection", plus & passed("Attribute", "execute", "executemany", "query"), "line", 1))
        out.append(("path_traversal", plus & (c("idx") == 0) & passed("Name", "open"), "line", 1))
    return out


_PLACES = ("line", "above_line", "owner_line", "callee_line")


def issues(all_nodes: DataFrame, keys: list[str] | None = None, helpers: bool = False, nesting: bool = False) -> DataFrame:
    """Issue rows of every rule.  ``keys``: columns that tell files apart.  ``helpers``: with the two stand-alone checks too;
    ``nesting``: with the findings of :func:`deep_nesting`, after all others."""
    keys = keys or ["path"]
    table = conditions(helpers)
    nothing = F.array().cast("array<int>")
    known, found = [], []
    for i, (rule, test, place, times) in enumerate(table):
        severity, title = RULES[rule]
        category = "security" if rule in SECURITY_RULES else "syntax" if rule == "syntax_error" else "code_quality"
        known.append((rule, title, category, severity, FIXES.get(rule), 1.0 if rule == "syntax_error" else 0.9 if rule in SECURITY_RULES else 0.8, _PLACES.index(place)))
        found.append(F.when(test, F.lit(i)) if isinstance(times, int) else F.when(test, F.array_repeat(F.lit(i), times)))
    single = F.array_compact(F.array(*[f for f, t in zip(found, table) if isinstance(t[3], int)]))
    many = [F.coalesce(f, nothing) for f, t in zip(found, table) if not isinstance(t[3], int)]
    if nesting:
        severity, title = RULES["high_complexity"]
        many.append(F.array_repeat(F.lit(len(known)), _deep()))
        known.append(("high_complexity", title, "maintainability", severity, None, 0.9, 0))
    facts = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(k, ("string",) * 5 + ("double", "int"), ("rule_id", "title", "category", "severity", "suggested_fix", "confidence_score", "place"))]) for k in known])
    rows = all_nodes.select(*keys, "node", "depth", *_PLACES, "end_line", F.explode(F.concat(single, *many)).alias("_rule"))
    shown = rows.withColumn("_r", F.element_at(facts, F.col("_rule") + 1))
    at = F.element_at(F.array(*[F.col(p) for p in _PLACES]), F.col("_r.place") + 1)
    deep = F.col("_rule") == (len(table) if nesting else -1)
    return shown.select(
        *keys,
        *[F.col(f"_r.{c}").alias(c) for c in ("title", "category", "severity", "rule_id", "suggested_fix", "confidence_score")],
        F.when(deep, F.concat(F.lit("Complex control flow detected (depth: "), F.col("depth").cast("string"), F.lit(")"))).alias("description"),
        at.cast("int").alias("line_start"),
        F.when(deep, F.col("end_line")).cast("int").alias("line_end"),
        # by rule, then by place: a file has fewer nodes than that
        (F.shiftleft(F.col("_rule").cast("long"), 40) + F.col("node")).alias("seq"),
    )


def _deep() -> Column:
    """How many findings of deep nesting a node is: itself as control flow, and one and/or of a chain that stands before it."""
    joint = (F.col("above_kind") == "BoolOp") & (F.col("field") == "values") & (F.col("idx") > 0)
    is_elif = _is("If") & (F.col("above_kind") == "If") & (F.col("field") == "orelse") & (F.col("depth") == F.col("above_depth"))
    control = _is(*[k.__name__ for k in CONTROL]) & ~F.coalesce(is_elif, F.lit(False))
    return F.when(F.col("depth") > DEPTH, control.cast("int") + F.coalesce(joint, F.lit(False)).cast("int")).otherwise(0)


def deep_nesting(all_nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Control flow under more than ten levels of it: statements, conditional expressions, and each and/or of a chain.

    An elif belongs to its if and is no statement of its own; an and/or stands on the line of the operand that follows it.
    """
    keys = keys or ["path"]
    found = issues(all_nodes.where(F.col("depth") > DEPTH), keys, nesting=True).where(F.col("description").isNotNull())
    return found.select(*keys, "title", "description", "category", "severity", "rule_id", "line_start", "line_end", "confidence_score")


def definitions(all_nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Functions, classes, imports and variables of Python files as rows: kind, name, line, end_line, detail, complexity.

    A file that can't be parsed gives one row of kind error, whose detail says why.
    """
    keys = keys or ["path"]
    c, none = F.col, F.lit(None).cast("string")
    row = lambda kind, name, detail, score=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), detail.cast("string").alias("detail"), (F.lit(None) if score is None else score).cast("int").alias("complexity"))
    given = F.when(c("given_kind") == "Constant", c("given_type")).when(c("given_kind").isin("List", "Dict", "Set", "Tuple"), F.lower("given_kind")).when(c("given_kind") == "Call", F.coalesce(F.concat(F.lit("call_"), "given_call"), F.lit("call"))).otherwise("unknown")
    found = (
        F.when(_is("FunctionDef"), row("function", c("name"), F.array_join("parts", ","), complexity(asserts=False)))
        .when(_is("ClassDef"), row("class", c("name"), F.array_join("parts", ",")))
        .when(_is("alias") & (c("above_kind") == "Import"), row("import", c("name"), none))
        .when(_is("alias") & (c("above_kind") == "ImportFrom"), row("import", c("above_name"), c("name")))
        .when(_is("Name") & c("given_kind").isNotNull(), row("variable", c("name"), given))
        .when(_is("SyntaxError"), row("error", none, c("value")))
    )
    return all_nodes.select(*keys, "line", "end_line", found.alias("_d")).where("_d IS NOT NULL").select(*keys, "_d.kind", "_d.name", "line", "end_line", "_d.detail", "_d.complexity")


def bodies(files: DataFrame) -> DataFrame:
    """Functions of Python files with their context: name, line_start, line_end, body, args, returns, docstring, complexity.

    ``body`` is the function's source lines, ``returns`` its annotation written back as source.  One row for each function
    that isn't async, nested ones too; other languages and files that can't be parsed give none.
    """
    keys = [k for k in files.columns if k != "content"]
    own = nodes(files, bodies=True).where(_is("FunctionDef"))
    return own.select(*keys, "name", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"), "body", F.col("parts").alias("args"), "returns", F.col("doc").alias("docstring"), complexity(asserts=False).alias("complexity"))
