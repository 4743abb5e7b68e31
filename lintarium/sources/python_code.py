"""Facts of Python files, by the ``ast`` and ``tokenize`` modules."""

from __future__ import annotations

import ast
import io
import tokenize

from lintarium.sources.facts import Facts

# Names that rules look for.
LOG_OBJECTS = {"logger", "logging", "log"}
LOG_METHODS = {"debug", "info", "warning", "error", "critical", "exception", "log"}
BIND_CALLEES = {"bind", "run", "listen"}
DEBUG_CALLS = {"print", "pprint", "breakpoint"}
EVALS = {"eval", "exec", "__import__"}

_FN = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def _dotted(e: ast.AST) -> str:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        left = _dotted(e.value)
        return f"{left}.{e.attr}" if left else e.attr
    return ""


def _own(body: list[ast.AST]):
    """Nodes of a body without those of functions, classes and lambdas inside it."""
    stack = list(body)
    while stack:
        n = stack.pop()
        yield n
        if not isinstance(n, (*_FN, ast.ClassDef, ast.Lambda)):
            stack += ast.iter_child_nodes(n)


def cyclomatic(fn: ast.AST) -> int:
    n = 1
    for x in _own(fn.body):
        if isinstance(x, (ast.If, ast.With, ast.AsyncWith, *_LOOPS)):
            n += 1
        elif isinstance(x, ast.Try):
            n += max(0, len(x.handlers) - 1)
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += len(x.ifs)
    return n


def cognitive(fn: ast.AST) -> tuple[int, int]:
    """Cognitive complexity and deepest nesting of a function."""
    total = deepest = 0

    def flat(e: ast.AST) -> None:
        nonlocal total
        for x in ast.walk(e):
            if isinstance(x, ast.BoolOp):
                total += len(x.values) - 1
            elif isinstance(x, ast.comprehension):
                total += len(x.ifs)
            elif isinstance(x, ast.Lambda):
                total += 1

    def body(stmts: list[ast.stmt], depth: int) -> None:
        nonlocal total, deepest
        deepest = max(deepest, depth)
        for s in stmts:
            if isinstance(s, ast.If):
                total += depth + 1
                flat(s.test)
                body(s.body, depth + 1)
                if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If):
                    body(s.orelse, depth)
                elif s.orelse:
                    total += depth + 1
                    body(s.orelse, depth + 1)
            elif isinstance(s, (*_LOOPS, ast.With, ast.AsyncWith)):
                total += depth + 1
                for e in [s.test] if isinstance(s, ast.While) else [s.iter] if isinstance(s, (ast.For, ast.AsyncFor)) else [i.context_expr for i in s.items]:
                    flat(e)
                body(s.body, depth + 1)
                body(getattr(s, "orelse", []), depth + 1 if getattr(s, "orelse", []) else depth)
            elif isinstance(s, ast.Try):
                total += depth + 1
                body(s.body, depth + 1)
                for h in s.handlers:
                    total += depth + 1
                    body(h.body, depth + 1)
                body([*s.orelse, *s.finalbody], depth)
            elif isinstance(s, _FN):
                total += depth + 1
                body(s.body, depth + 1)
            elif isinstance(s, ast.ClassDef):
                body(s.body, depth + 1)
            elif isinstance(s, ast.Match):
                for c in s.cases:
                    body(c.body, depth + 1)
            elif isinstance(s, (ast.Break, ast.Continue)):
                total += 1
            else:
                flat(s)

    body(fn.body, 0)
    return total, deepest


def _exits(body: list[ast.stmt], loop: bool = True) -> bool:
    """Whether a loop's body can leave it: break at its level, return, raise or an exit call."""
    for s in body:
        if isinstance(s, (ast.Return, ast.Raise)) or (isinstance(s, ast.Break) and loop):
            return True
        if isinstance(s, (*_FN, ast.ClassDef)):
            continue
        if any(isinstance(x, (ast.Yield, ast.YieldFrom, ast.Await)) or (isinstance(x, ast.Call) and _dotted(x.func) in ("exit", "quit", "sys.exit", "os._exit")) for x in ast.walk(s) if not isinstance(s, (ast.If, ast.Try, *_LOOPS, ast.With))):
            return True
        inner = loop and not isinstance(s, _LOOPS)
        parts = [getattr(s, k, []) for k in ("body", "orelse", "finalbody")] + [h.body for h in getattr(s, "handlers", [])] + [c.body for c in getattr(s, "cases", [])]
        if any(_exits(p, inner) for p in parts if isinstance(p, list)):
            return True
    return False


def parse(f: Facts) -> None:
    tree = ast.parse(f.text)

    def at(n: ast.AST) -> tuple[int, int]:
        def place(line: int, col: int) -> int:
            text = f.line_text(line)
            return f.starts[line - 1] + (col if text.isascii() else len(text.encode()[:col].decode("utf-8", "ignore")))

        return place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)

    def add(kind: str, n: ast.AST, name: str | None = None, **attrs) -> None:
        f.add(kind, name, *at(n), **attrs)

    for t in tokenize.generate_tokens(io.StringIO(f.text).readline):
        if t.type == tokenize.COMMENT:
            start = f.starts[t.start[0] - 1] + t.start[1]
            f.add("comment", None, start, start + len(t.string), text=t.string.lstrip("#").strip())

    docs = set()
    for n in ast.walk(tree):
        if isinstance(n, (*_FN, ast.ClassDef, ast.Module)) and ast.get_docstring(n, clean=False) is not None:
            docs.add(id(n.body[0].value))
    parents: dict[int, ast.AST] = {}
    for n in ast.walk(tree):
        for c in ast.iter_child_nodes(n):
            parents[id(c)] = n

    def up(n: ast.AST, kinds: tuple) -> ast.AST | None:
        while (n := parents.get(id(n))) is not None and not isinstance(n, kinds):
            pass
        return n

    def params(fn) -> list[str]:
        a = fn.args
        return [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]

    guard = set()
    for s in tree.body:
        if isinstance(s, ast.If) and isinstance(s.test, ast.Compare) and "__name__" in (_dotted(s.test.left), *map(_dotted, s.test.comparators)):
            guard |= {id(x) for x in ast.walk(s)}

    for n in ast.walk(tree):
        if isinstance(n, _FN):
            parent = parents.get(id(n))
            cls = parent.name if isinstance(parent, ast.ClassDef) else None
            doc = ast.get_docstring(n, clean=False)
            cog, nest = cognitive(n)
            body = at(n.body[0])[0], at(n.body[-1])[1]
            names = params(n)
            shown = names[1:] if cls and names[:1] in (["self"], ["cls"]) else names
            add("function", n, n.name, fn_kind="Method" if cls else "Function", visibility="Private" if n.name.startswith("_") else "Public", params=len(shown), param_names=",".join(names), is_async=isinstance(n, ast.AsyncFunctionDef), is_test=n.name.startswith("test_") or bool(cls and cls.startswith("Test") and n.name.startswith("test")), parent=cls, doc=doc, cyclomatic=cyclomatic(n), cognitive=cog, nesting=nest, returns=sum(isinstance(x, ast.Return) for x in _own(n.body)), body_start=f.byte(body[0]), body_end=f.byte(body[1]), body_lines=n.end_lineno - n.body[0].lineno + 1, body=f.text[body[0] : body[1]], signature=f.text[at(n)[0] : body[0]], top=isinstance(parent, ast.Module), region=f.text[max(0, at(n)[0] - 256) : body[1]])
        elif isinstance(n, ast.ClassDef):
            add("type", n, n.name, visibility="Private" if n.name.startswith("_") else "Public", doc=ast.get_docstring(n, clean=False), top=isinstance(parents.get(id(n)), ast.Module))
        elif isinstance(n, ast.Import):
            for a in n.names:
                add("import", n, a.name, top=isinstance(parents.get(id(n)), ast.Module))
        elif isinstance(n, ast.ImportFrom):
            add("import", n, "." * n.level + (n.module or ""), top=isinstance(parents.get(id(n)), ast.Module))
        elif isinstance(n, ast.Constant) and isinstance(n.value, str):
            if id(n) in docs:
                add("doc", n, None, text=n.value)
            else:
                add("string", n, None, value=n.value)
        if isinstance(n, ast.Call):
            name = _dotted(n.func)
            last = name.rsplit(".", 1)[-1]
            if isinstance(n.func, ast.Name) and name in EVALS:
                add("call_sites", n, name)
            if isinstance(n.func, ast.Name) and name in ("eval", "exec"):
                add("dangerous_calls", n, name)
            if (name in DEBUG_CALLS or name in ("pprint.pprint", "pdb.set_trace")) and id(n) not in guard:
                add("debug_calls", n, "pdb.set_trace" if last == "set_trace" else last)
            if name.split(".")[0] == "re" and last in ("compile", "match", "search", "findall", "fullmatch", "sub", "split", "finditer") and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                add("regex", n.args[0], None, value=n.args[0].value)
            if last in BIND_CALLEES:
                values = [*n.args, *[k.value for k in n.keywords if k.arg in ("host", "address")]]
                hosts = [v.value if isinstance(v, ast.Constant) else v.elts[0].value for v in values if isinstance(v, ast.Constant) or (isinstance(v, ast.Tuple) and v.elts and isinstance(v.elts[0], ast.Constant))]
                add("bind_call_sites", n, last, arg=next((h for h in hosts if isinstance(h, str)), None))
            if isinstance(n.func, ast.Attribute) and last in LOG_METHODS and _dotted(n.func.value).rsplit(".", 1)[-1] in LOG_OBJECTS and n.args:
                fn = up(n, _FN)
                first = n.args[0]
                shaped = isinstance(first, (ast.JoinedStr, ast.BinOp)) or (isinstance(first, ast.Constant) and isinstance(first.value, str) and any(m in first.value for m in ("%s", "%d", "%r", "{}"))) or (isinstance(first, ast.Call) and _dotted(first.func).endswith("format"))
                names = {x.id for a in n.args for x in ast.walk(a) if isinstance(x, ast.Name)}
                add("log_calls", n, last, placeholder=shaped, args=",".join(sorted(names)), params=",".join(params(fn)) if fn else "")
        elif isinstance(n, ast.While) and isinstance(n.test, ast.Constant) and n.test.value in (True, 1) and not _exits(n.body):
            add("infinite_loops", n)
        elif isinstance(n, ast.Match):
            last = n.cases[-1]
            default = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in n.cases)
            add("switch_sites", n, None, has_default=default, arms=len(n.cases), at=last.body[0].lineno)
        if isinstance(n, (ast.If, *_LOOPS, ast.With, ast.Try, ast.ExceptHandler)) and len(n.body) == 1 and (isinstance(n.body[0], ast.Pass) or (isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and n.body[0].value.value is ...)):
            add("empty_blocks", n, type(n).__name__)
        if isinstance(n, (*_FN, ast.ClassDef)):
            marked = any("deprecated" in (_dotted(d.func if isinstance(d, ast.Call) else d).rsplit(".", 1)[-1],) for d in n.decorator_list)
            warned = isinstance(n, _FN) and any(isinstance(x, ast.Call) and _dotted(x.func).rsplit(".", 1)[-1] == "warn" and any(_dotted(a).rsplit(".", 1)[-1] in ("DeprecationWarning", "PendingDeprecationWarning") for a in [*x.args, *[k.value for k in x.keywords]]) for x in _own(n.body))
            if marked or warned:
                add("deprecated_items", n, n.name)
        for block in [getattr(n, k, None) for k in ("body", "orelse", "finalbody")]:
            if isinstance(block, list):
                for a, b in zip(block, block[1:]):
                    if isinstance(a, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                        add("unreachable_stmts", b)
                        break
        if isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None:
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                name = _dotted(t).rsplit(".", 1)[-1]
                if name and isinstance(n.value, ast.Constant) and isinstance(n.value.value, (str, int, float, bytes)) and not isinstance(n.value.value, bool):
                    add("assignments", n, name, value=n.value.value if isinstance(n.value.value, str) else repr(n.value.value), literal="Str" if isinstance(n.value.value, str) else "Int")
        if isinstance(n, ast.Global) and up(n, _FN):
            for name in n.names:
                add("mutable_global", n, name)
    for s in tree.body:
        if isinstance(s, (ast.Assign, ast.AnnAssign)):
            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                if isinstance(t, ast.Name):
                    add("module_name", s, t.id)
        plain = isinstance(s, (ast.Import, ast.ImportFrom, *_FN, ast.ClassDef, ast.Assign, ast.AnnAssign, ast.Pass)) or id(s) in guard or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) or isinstance(s, (ast.If, ast.Try))
        add("top_level_stmts", s, type(s).__name__, allowed=plain)
    _references(f, tree, at)


def _references(f: Facts, tree: ast.Module, at) -> None:
    """Reads and writes of names in each function; ``skip`` marks writes that are never dead stores."""
    for fn in [n for n in ast.walk(tree) if isinstance(n, _FN)]:
        tried = {id(x) for t in ast.walk(fn) if isinstance(t, ast.Try) for x in ast.walk(t)}
        skip = {x.target.id for x in ast.walk(fn) if isinstance(x, ast.AugAssign) and isinstance(x.target, ast.Name)}
        skip |= {y.id for x in ast.walk(fn) if isinstance(x, (ast.For, ast.AsyncFor, ast.comprehension)) for y in ast.walk(x.target) if isinstance(y, ast.Name)}
        skip |= {name for x in ast.walk(fn) if isinstance(x, (ast.Global, ast.Nonlocal)) for name in x.names}
        inner = {y.id for x in ast.walk(fn) if isinstance(x, (*_FN, ast.Lambda)) and x is not fn for y in ast.walk(x) if isinstance(y, ast.Name)}
        for n in _own(fn.body):
            if isinstance(n, ast.Name):
                write = isinstance(n.ctx, ast.Store)
                f.add("ref", n.id, *at(n), fn=f"{fn.name}@{fn.lineno}", event="write" if write else "read", skip=write and (n.id.startswith("_") or id(n) in tried or n.id in skip or n.id in inner))
