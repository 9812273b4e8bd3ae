"""Facts of a Python file, from its syntax tree: imports, calls and reads, each with where its value comes from."""

from __future__ import annotations

import ast
from collections.abc import Iterator

#: Verbs, arguments that carry a body, callees that register a route, roots that do so with a verb.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
BODY = ("data", "json", "body", "payload", "params_json", "content", "files")
REGISTRARS = ("route", "add_route", "add_api_route", "include_router", "APIRouter", "add_url_rule", "websocket", "middleware", "mount")
SERVERS = ("app", "router", "api", "blueprint", "bp")
#: How often a value is followed to where it was assigned, and a name to the dictionary it stands for.
HOPS, NAMES = 6, 3
LONGEST = 300


def literal(node: ast.AST) -> str | None:
    """A text written out, with {} for what is filled in; None if nothing of it is."""
    match node:
        case ast.Constant(value=str(text)):
            return text
        case ast.JoinedStr(values=parts):
            return "".join(p.value if isinstance(p, ast.Constant) and isinstance(p.value, str) else "{}" for p in parts)
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            x, y = literal(a), literal(b)
            return None if x is None and y is None else (x if x is not None else "{}") + (y if y is not None else "{}")
        case ast.BinOp(left=a, op=ast.Mod()):
            return literal(a)
    return None


def steps(node: ast.AST) -> tuple[ast.AST, list[str]]:
    """What an access starts from, and the names on the way: attributes, texts in brackets, and those asked for by get()."""
    out: list[str] = []
    while True:
        match node:
            case ast.Attribute(value=inner, attr=name):
                out.append(name)
            case ast.Subscript(value=inner, slice=ast.Constant(value=str(name))):
                out.append(name)
            case ast.Subscript(value=inner):
                pass
            case ast.Call(func=ast.Attribute(value=inner, attr="get" | "setdefault"), args=[ast.Constant(value=str(name)), *_]):
                out.append(name)
            case ast.Await(value=inner):
                pass
            case _:
                return node, out[::-1]
        node = inner


def dotted(node: ast.AST) -> str:
    """a.b.c of a callee; a call on the way counts by its own callee."""
    parts: list[str] = []
    while True:
        match node:
            case ast.Attribute(value=inner, attr=name):
                parts.append(name)
                node = inner
            case ast.Call(func=inner) | ast.Await(value=inner) | ast.Subscript(value=inner):
                node = inner
            case ast.Name(id=name):
                return ".".join([name, *parts[::-1]])
            case _:
                return ".".join(parts[::-1])


class File:
    def __init__(self, source: str):
        self.tree = ast.parse(source)
        self.lines = source.splitlines()
        self.assigned: dict[str, ast.AST] = {}
        self.modules: dict[str, str] = {}
        for node in ast.walk(self.tree):
            match node:
                case ast.Assign(targets=targets, value=value):
                    self.assigned.update({t.id: value for t in targets if isinstance(t, ast.Name)})
                case ast.AnnAssign(target=ast.Name(id=name), value=ast.AST() as value):
                    self.assigned[name] = value
                case ast.Import(names=names):
                    self.modules.update({(a.asname or a.name).split(".")[0]: a.name for a in names})
                case ast.ImportFrom(module=str(module), names=names):
                    self.modules.update({a.asname or a.name: module for a in names})

    def origins(self, node: ast.AST, hops: int = HOPS) -> set[str]:
        """Where a value comes from: name:x of the roots met, module:m of imports, text:... of what a call on the way wrote out."""
        match node:
            case ast.Await(value=inner) | ast.Attribute(value=inner) | ast.Subscript(value=inner):
                return self.origins(inner, hops)
            case ast.Call(func=func):
                texts = {f"text:{t.lower()[:LONGEST]}" for x in ast.walk(node) if (t := literal(x)) and "." in t}
                return texts | self.origins(func, hops)
            case ast.Name(id=name):
                out = {f"name:{name.lower()}"}
                if name in self.modules:
                    out.add(f"module:{self.modules[name].lower()}")
                if hops and name in self.assigned:
                    out |= self.origins(self.assigned[name], hops - 1)
                return out
        return set()

    def keys(self, node: ast.AST, hops: int = NAMES) -> Iterator[str]:
        """Names under which something is sent: keywords and keys of dictionaries, written here or under a name."""
        match node:
            case ast.Call(args=args, keywords=keywords):
                for k in keywords:
                    if k.arg:
                        yield k.arg
                    yield from self.keys(k.value, hops)
                for a in args:
                    yield from self.keys(a, hops)
            case ast.Dict(keys=keys, values=values):
                for k, v in zip(keys, values, strict=True):
                    if isinstance(k, ast.Constant) and isinstance(k.value, str):
                        yield k.value
                    yield from self.keys(v, hops)
            case ast.List(elts=elts) | ast.Tuple(elts=elts):
                for e in elts:
                    yield from self.keys(e, hops)
            case ast.Starred(value=inner):
                yield from self.keys(inner, hops)
            case ast.Name(id=name) if hops and isinstance(self.assigned.get(name), ast.Dict | ast.Call | ast.Name):
                held = self.assigned[name]
                if not isinstance(held, ast.Call) or dotted(held.func) == "dict":
                    yield from self.keys(held, hops - 1)

    def methods(self, call: ast.Call) -> set[str]:
        """The verbs that a call names: as its callee or part of its name, as a text, as a keyword; a body means one that writes."""
        callee = dotted(call.func).rsplit(".", 1)[-1].lower()
        out = {callee} & set(VERBS) or set(next(([v] for v in VERBS if callee.startswith(f"{v}_") or callee.endswith(f"_{v}")), []))
        out |= {t.strip().lower() for a in [*call.args, *(k.value for k in call.keywords)] if (t := literal(a))} & set(VERBS)
        out |= {t.strip().lower() for k in call.keywords if k.arg in ("method", "verb", "http_method") and (t := literal(k.value))}
        return out or ({"post", "put", "patch"} if any(k.arg in BODY for k in call.keywords) else set())

    def registers(self, call: ast.Call) -> bool:
        """Whether a call serves a path instead of asking for it."""
        parts = dotted(call.func).split(".")
        return parts[-1] in REGISTRARS or parts[0] in SERVERS and parts[-1] in VERBS or any(k.arg == "prefix" for k in call.keywords)

    def text(self, node: ast.AST) -> dict:
        line = getattr(node, "lineno", 0)
        return {"line": line, "text": self.lines[line - 1].strip()[:160] if 0 < line <= len(self.lines) else ""}

    def facts(self) -> Iterator[dict]:
        for local, module in self.modules.items():
            yield {"fact": "import", "target": local, "module": module, "line": 0, "text": ""}
        targets = {id(v.value if isinstance(v, ast.Await) else v): name for name, v in self.assigned.items()}
        called = {id(n.func) for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Call):
                strings = {t[:LONGEST] for x in ast.walk(node) if (t := literal(x))}
                yield self.text(node) | {
                    "fact": "call", "chain": dotted(node.func), "target": targets.get(id(node)), "keys": sorted(set(self.keys(node))), "strings": sorted(strings), "methods": sorted(self.methods(node)),
                    "origins": sorted(self.origins(node)), "registers": self.registers(node),
                }
            is_read = isinstance(node, ast.Attribute | ast.Subscript) and isinstance(node.ctx, ast.Load) and id(node) not in called
            asked = isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("get", "setdefault") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str)
            if is_read or asked:
                root, position = steps(node)
                if position and not (isinstance(node, ast.Subscript) and not (isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str))):
                    yield self.text(node) | {"fact": "read", "chain": dotted(root), "position": position, "origins": sorted(self.origins(root))}


def facts(source: str) -> list[dict]:
    return list(File(source).facts())
