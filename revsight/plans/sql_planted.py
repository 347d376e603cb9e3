"""Source files planted by customer, with the findings that each must give, written down by hand; the SQL counts those."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, scan, syntax
from .registry import register

_BODY = "".join("    if a:\n        a()\n" for _ in range(10))
_LONG = "    a()\n" * 51
_METHODS = "".join(f"    def _m{i}(self):\n        pass\n" for i in range(21))

#: (name, text, findings of patterns, findings of syntax rules); a finding is (rule, line).
PLANTED = (
    ("s.py", 'password = "hunter2hunter2"\n', [("hardcoded_password", 1)], [("hardcoded_credential", 1)]),
    ("s.py", 'cur.execute("select %s" % x)\n', [("sql_injection", 1), ("command_injection", 1), ("command_injection", 1)], [("old_string_format", 1)]),
    ("s.py", 'import os\nos.system("ls " + d)\n', [("command_injection", 2)], []),
    ("s.py", 'import hashlib\nh = hashlib.md5(b"x")\ng = hashlib.sha1(b"y")\n', [("weak_crypto", 2), ("weak_crypto", 3)], []),
    ("s.py", "import random\nx = random.choice([a])\ny = random.randint(0, 1)\n", [("insecure_random", 2), ("insecure_random", 3)], []),
    ("s.py", "eval(s)\nexec(s)\n", [("eval_usage", 1)], [("eval_usage", 1), ("exec_usage", 2)]),
    ("s.py", "import pickle\np = pickle.loads(s)\nq = pickle.load(f)\n", [("pickle_usage", 2), ("pickle_usage", 3)], []),
    ("s.py", "app.run(debug=True)\n", [("debug_mode", 1)], []),
    ("s.py", f"def _f(a):\n{_BODY}", [], [("high_complexity", 1)]),
    ("s.py", f"def _f(a):\n{_LONG}", [], [("long_function", 1)]),
    ("s.py", "def _f(a, b, c, d, e, f):\n    pass\ndef _g(a, b, c, d, e, f, g, h):\n    pass\n", [], [("too_many_params", 1), ("too_many_params", 3), ("long_parameter_list", 3)]),
    ("s.py", f'class A:\n    """Doc."""\n{_METHODS}', [], [("large_class", 1)]),
    ("s.py", "x = 7\ny = -1\nz = 2.5\n", [], [("magic_number", 1), ("magic_number", 3)]),
    ("s.py", "def work():\n    pass\nclass B:\n    pass\n", [], [("missing_docstring", 1), ("missing_class_docstring", 3)]),
    ("s.py", 'def _Work():\n    pass\nclass low_er:\n    """Doc."""\n', [], [("function_naming", 1), ("class_naming", 3)]),
    ("s.py", "def _f(a=[], b={}):\n    pass\n", [], [("mutable_default", 1), ("mutable_default", 1)]),
    ("s.py", "if x == None:\n    pass\n", [], [("none_comparison", 1)]),
    ("s.py", "try:\n    f()\nexcept:\n    pass\n", [], [("bare_except", 3), ("except_pass", 3)]),
    ("s.py", 'for i in z:\n    z.append(i)\n    t += "x"\n', [], [("inefficient_loop", 1), ("string_concat_loop", 1)]),
    ("s.py", "def _f():\n    global q, r\n    q = 2\n", [], [("global_usage", 2), ("global_usage", 2), ("magic_number", 3), ("unused_variable", 1)]),
    ("s.py", "def _f():\n    return g()\n    h()\n", [], [("unreachable_code", 3)]),
    ("s.py", "def _f():\n    value = g()\n", [], [("unused_variable", 1)]),
    ("s.py", "assert x\nsubprocess.run(c, shell=True)\n", [], [("assert_in_production", 1), ("shell_true", 2)]),
    ("s.py", 'cur.execute("a" + b)\nopen("d/" + n)\n', [], [("sql_injection", 1), ("path_traversal", 2)]),
    ("s.py", "def (:\n", [], [("syntax_error", 1)]),
    ("test_s.py", 'password = "realpass1"\n', [("hardcoded_password", 1)], [("hardcoded_credential", 1)]),
    ("s.js", "eval(a);\nel.innerHTML = a + b;\ndocument.write(a);\nvar r = Math.random();\n", [("eval_usage", 1), ("innerHTML_xss", 2), ("document_write", 3), ("insecure_random", 4)], []),
    ("s.java", 'Statement s; s.executeQuery("q" + a);\nnew File("/x" + s);\nMessageDigest.getInstance("MD5");\n', [("sql_injection", 1), ("path_traversal", 2), ("weak_crypto", 3)], []),
    ("requirements.txt", "requests==2.25.0\nflask>=1.0.1\ndjango==3.0\n", [], []),
    ("s.yaml", "password: \"abcde\"\napi_key: \"0123456789a\"\nsecret_key = '0123456789a'\ntoken: \"0123456789a\"\n", [], []),
    ("s.ts", "import { a } from 'm';\nclass K extends L {\ninterface I {\nfunction go(x) {\nvar b = (y) => {\n# TODO\nconsole.log(y)\n", [], []),
)
#: (place in PLANTED, rule, line, does the line move with the text) of findings that go by the kind of file.
BY_KIND = (
    (25, "test_credentials", 1, 0),
    (28, "vulnerable_dependency", 1, 0),
    (28, "vulnerable_dependency", 1, 0),
    (29, "config_secrets", 1, 1),
    (29, "config_secrets", 2, 1),
    (29, "config_secrets", 3, 1),
    (29, "config_secrets", 4, 1),
)
#: (place in PLANTED, kind, name, line) of definitions.
DEFINED = ((30, "import", "m", 1), (30, "class", "K", 2), (30, "interface", "I", 3), (30, "function", "go", 4), (30, "function", "b", 5))
#: (place in PLANTED, rule, line) of custom rules.
CUSTOM = ((0, "no_hardcoded_secrets", 1), (25, "no_hardcoded_secrets", 1), (30, "no_todo_comments", 6), (30, "no_debug_prints", 7))
_N = len(PLANTED)


def customers(spark, sf_dir):  # noqa: ANN001, ANN201
    """The keys of customers, dealt over all cores before texts are made of them: a small table is read as one part."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)


def planted_files(spark, sf_dir):  # noqa: ANN001, ANN201
    """A file for each customer: one of the planted texts below none to four empty lines."""
    texts = F.broadcast(spark.createDataFrame([(i, n, c) for i, (n, c, _, _) in enumerate(PLANTED)], "k long, name string, text string"))
    held = customers(spark, sf_dir).select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % _N).alias("k"))
    path = F.concat(F.lit("src/p"), "file_id", F.lit("/"), "name")
    return held.join(texts, "k").select("file_id", path.alias("path"), F.concat(F.repeat(F.lit("\n"), (F.col("file_id") % 5).cast("int")), "text").alias("content"))


def _expected(rows) -> str:  # noqa: ANN001
    """SQL that counts the written-down findings (place, rule, line, moves) over all customers."""
    values = ", ".join(f"({k}, '{rule}', {line}, {moves})" for k, rule, line, moves in rows)
    return f"SELECT c_custkey AS file_id, rule_id, CAST(line + moves * (c_custkey % 5) AS INTEGER) AS line_start, count(*) AS issues FROM customer JOIN (VALUES {values}) AS e(k, rule_id, line, moves) ON c_custkey % {_N} = e.k GROUP BY ALL"


def _counted(found):  # noqa: ANN001, ANN202
    return found.groupBy("file_id", "rule_id", "line_start").agg(F.count("*").alias("issues"))


@register("planted_patterns", _expected([(k, r, line, 1) for k, p in enumerate(PLANTED) for r, line in p[2]]))
def planted_patterns(spark, sf_dir):  # noqa: ANN001, ANN201
    return _counted(scan.pattern_issues(planted_files(spark, sf_dir)))


@register("planted_syntax", _expected([(k, r, line, 1) for k, p in enumerate(PLANTED) for r, line in p[3]]))
def planted_syntax(spark, sf_dir):  # noqa: ANN001, ANN201
    tree = syntax.nodes(planted_files(spark, sf_dir).select("file_id", "path", "content"))
    return _counted(syntax.issues(tree, ["file_id"], helpers=True))


@register("planted_context", _expected(BY_KIND))
def planted_context(spark, sf_dir):  # noqa: ANN001, ANN201
    return _counted(scan.context_issues(planted_files(spark, sf_dir)))


@register("planted_custom", _expected([(*c, 1) for c in CUSTOM]))
def planted_custom(spark, sf_dir):  # noqa: ANN001, ANN201
    return _counted(scan.custom_issues(planted_files(spark, sf_dir), list(rules.CUSTOM)))


@register(
    "planted_structure",
    f"SELECT 'src/p' || c_custkey || '/s.ts' AS path, 'typescript' AS language, kind, name, CAST(line + c_custkey % 5 AS INTEGER) AS line FROM customer JOIN (VALUES {', '.join(str(d) for d in DEFINED)}) AS e(k, kind, name, line) ON c_custkey % {_N} = e.k",
)
def planted_structure(spark, sf_dir):  # noqa: ANN001, ANN201
    return scan.structure(planted_files(spark, sf_dir)).where("language = 'typescript'").select("path", "language", "kind", "name", "line")


@register("deep_nesting", "SELECT c_custkey AS file_id, CAST(n AS INTEGER) AS line_start, CAST(n AS INTEGER) - 1 AS depth FROM customer, range(12, 17) t(n) WHERE n <= c_custkey % 17")
def deep_nesting(spark, sf_dir):  # noqa: ANN001, ANN201
    """Files of up to 16 conditions, each in the one before; one at line n stands below n - 1 others."""
    n = (F.col("c_custkey") % 17).cast("int")
    steps = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.repeat(F.lit(" "), i - 1), F.lit("if a:\n")))
    made = customers(spark, sf_dir).select(F.col("c_custkey").alias("file_id"), F.lit("deep.py").alias("path"), F.concat(F.array_join(steps, ""), F.repeat(F.lit(" "), n), F.lit("pass\n")).alias("content"))
    found = syntax.deep_nesting(syntax.nodes(made), ["file_id"])
    return found.select("file_id", "line_start", F.regexp_extract("description", r"(\d+)\)$", 1).cast("int").alias("depth"))


_RETURNS = ("dict[str, list[int]] | None", "Callable[..., 'K']", "tuple[int, *Ts]", "Annotated[int, x > 1]", "None", "a.b[1:2, ::3]", "lambda: (yield)")


@register(
    "planted_bodies",
    f"""WITH f AS (SELECT c_custkey AS file_id, CAST(c_custkey % 3 + 1 AS INTEGER) AS line_start, CAST(c_custkey % 5 AS INTEGER) AS n, ([{", ".join("'" + r.replace("'", "''") + "'" for r in _RETURNS)}])[c_custkey % {len(_RETURNS)} + 1] AS returns FROM customer)
SELECT file_id, 'f' || file_id AS name, line_start, line_start + 2 * n + 2 AS line_end,
  'def f' || file_id || '(a, b=2, *c) -> ' || returns || ':' || chr(10) || '    \"\"\"Doc ' || file_id || '.\"\"\"' || repeat(chr(10) || '    if a:' || chr(10) || '        b()', n) || chr(10) || '    return a' AS body,
  'a,b' AS args, returns, 'Doc ' || file_id || '.' AS docstring, 1 + n AS complexity FROM f
UNION ALL SELECT file_id, 'm', line_start + 2 * n + 6, line_start + 2 * n + 7, '    def m(self):' || chr(10) || '        return self', 'self', NULL, NULL, 1 FROM f""".replace('\\"', '"'),
)
def planted_bodies(spark, sf_dir):  # noqa: ANN001, ANN201
    """A file for each customer with a function of a size, place and return annotation of its own, and a method."""
    k = F.col("c_custkey")
    returns = F.element_at(F.array(*[F.lit(r) for r in _RETURNS]), (k % len(_RETURNS) + 1).cast("int"))
    head = F.concat(F.repeat(F.lit("\n"), (k % 3).cast("int")), F.lit("def f"), k, F.lit("(a, b=2, *c) -> "), returns, F.lit(':\n    """Doc '), k, F.lit('."""\n'))
    text = F.concat(head, F.repeat(F.lit("    if a:\n        b()\n"), (k % 5).cast("int")), F.lit("    return a\n\n\nclass K:\n    def m(self):\n        return self\n"))
    made = customers(spark, sf_dir).select(k.alias("file_id"), F.lit("b.py").alias("path"), text.alias("content"))
    return syntax.bodies(made).drop("path").withColumn("args", F.array_join("args", ","))
