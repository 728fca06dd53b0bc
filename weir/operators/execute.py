"""What only Python can judge: accents of all scripts, Python syntax, arithmetic, and code run against tests."""

from __future__ import annotations

import ast
import json
import math
import operator
import re
import subprocess
import sys
import tempfile
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators import segment

# What an arithmetic expression may hold.
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
CALLS = {
    "sqrt": math.sqrt, "abs": abs, "round": round, "min": min, "max": max, "sum": sum, "pow": pow, "factorial": math.factorial, "gcd": math.gcd,
    "log": math.log, "log2": math.log2, "log10": math.log10, "exp": math.exp, "sin": math.sin, "cos": math.cos, "tan": math.tan, "floor": math.floor, "ceil": math.ceil,
}
NAMES = {"pi": math.pi, "e": math.e, "tau": math.tau}
LARGEST = 1000
IMPORTS = frozenset("math re json string itertools functools collections random datetime statistics operator typing heapq bisect copy decimal fractions".split())


def folded(text: str) -> str:
    """Lower-cased ASCII letters and digits of a text without accents, other signs as one space."""
    plain = unicodedata.normalize("NFKD", text).casefold()
    return " ".join(re.findall("[a-z0-9]+", "".join(c for c in plain if not unicodedata.combining(c))))


def parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


class _Arithmetic(ast.NodeVisitor):
    """Values of the nodes of an expression; ValueError for what is no arithmetic."""

    def generic_visit(self, node: ast.AST) -> float:
        raise ValueError(type(node).__name__)

    def visit_Constant(self, node: ast.Constant) -> float:
        if type(node.value) not in (int, float):
            raise ValueError("no number")
        return node.value

    def visit_Name(self, node: ast.Name) -> float:
        if node.id not in NAMES:
            raise ValueError(node.id)
        return NAMES[node.id]

    def visit_UnaryOp(self, node: ast.UnaryOp) -> float:
        signs = {ast.UAdd: operator.pos, ast.USub: operator.neg}
        if type(node.op) not in signs:
            raise ValueError("operator")
        return signs[type(node.op)](self.visit(node.operand))

    def visit_BinOp(self, node: ast.BinOp) -> float:
        if type(node.op) not in BINARY:
            raise ValueError("operator")
        left, right = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Pow):
            self._bounded(right)
        return BINARY[type(node.op)](left, right)

    def visit_List(self, node: ast.List) -> list:
        return [self.visit(e) for e in node.elts]

    visit_Tuple = visit_List

    def visit_Call(self, node: ast.Call) -> float:
        name = getattr(node.func, "id", None)
        if name not in CALLS or node.keywords:
            raise ValueError("call")
        own = [self.visit(a) for a in node.args]
        if name in ("factorial", "pow"):
            self._bounded(own[-1])
        return CALLS[name](*own)

    @staticmethod
    def _bounded(x: float) -> None:
        if abs(x) > LARGEST:
            raise ValueError("too large")


def _shown(x: object) -> str:
    return str(x) if not isinstance(x, float) else str(int(x)) if x.is_integer() else f"{x:.10g}"


def calculated(code: str) -> str | None:
    """What lines of arithmetic, bare or printed, fenced or not, come to; one line each. Null for anything else."""
    body = re.sub(r"^```(?:python)?|```$", "", code.strip()).strip()
    try:
        tree, out = ast.parse(body), []
        for line in tree.body:
            node = getattr(line, "value", None) if isinstance(line, ast.Expr) else None
            if node is None:
                return None
            printed = isinstance(node, ast.Call) and getattr(node.func, "id", None) == "print" and not node.keywords
            out.append(" ".join(_shown(_Arithmetic().visit(a)) for a in (node.args if printed else [node])))
    except (SyntaxError, ValueError, ArithmeticError, TypeError, RecursionError, MemoryError):
        return None
    return "\n".join(out) or None


def allowed(code: str) -> bool:
    """Whether a program parses and imports nothing but harmless modules."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    for node in ast.walk(tree):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        if any(n.split(".")[0] not in IMPORTS for n in names):
            return False
    return True


def outcome(code: str, name: str, tests: list[dict], seconds: float = 5.0) -> str:
    """pass, mismatch, error, timeout or refused: function `name` of a program run on tests (args, expected) in a process of its own."""
    if not allowed(code) or not name.isidentifier():
        return "refused"
    check = f"""
import json as _json, sys as _sys
for _t in _json.loads(_sys.argv[1]):
    if {name}(*_t["args"]) != _t["expected"]:
        print("mismatch")
        break
else:
    print("pass")
"""
    with tempfile.TemporaryDirectory() as at:
        path = Path(at, "program.py")
        path.write_text(code + check, encoding="utf-8")
        try:
            ran = subprocess.run([sys.executable, "-I", str(path), json.dumps(tests)], capture_output=True, text=True, timeout=seconds, cwd=at, check=False)
        except subprocess.TimeoutExpired:
            return "timeout"
    said = ran.stdout.strip().splitlines()[-1:]
    return said[0] if said in (["pass"], ["mismatch"]) else "error"


def _mapped(f: Callable, kind: str) -> Callable[[Column], Column]:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(f, na_action="ignore")

    return lambda column: F.pandas_udf(run, kind)(column)


def fold(column: Column) -> Column:
    return _mapped(folded, "string")(column)


def python_ok(column: Column) -> Column:
    return _mapped(parses, "boolean")(column)


def evaluate(column: Column) -> Column:
    return _mapped(calculated, "string")(column)


def python_part(text: Column, lang: Column) -> Column:
    """What of a record is Python: its fenced blocks of that language (of any, if the record is Python), else its lines without marks."""
    blocks = F.transform(F.filter(segment.fences(text), lambda b: (F.lower(lang) == "python") | F.lower(b["lang"]).isin("python", "py")), lambda b: b["code"])
    plain = F.array_join(F.filter(F.split(text, "\n"), lambda v: ~v.rlike(r"^(?:<filename>|<reponame>|<\|)")), "\n")
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(plain)


def verified(df: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Rows (id, code, entrypoint, tests as JSON of args and expected) with an `outcome`. Programs run: use it where that is safe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "outcome": [outcome(c or "", n or "", json.loads(t or "[]"), seconds) for c, n, t in zip(rows["code"], rows["entrypoint"], rows["tests"], strict=True)]})

    return df.select("id", "code", "entrypoint", "tests").mapInPandas(run, f"id {dict(df.dtypes)['id']}, outcome string")
