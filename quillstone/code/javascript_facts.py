"""Facts of a JavaScript or TypeScript file, JSX too, from its tokens: imports, calls, reads and version pins.

Tokens of expressions inside templates and JSX are streams of their own, read like the file's. Text
that does not end (a string, template, comment or element) makes the file unreadable: then nothing
in it can be told, and that is said.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quillstone.code.python_facts import HOPS, LONGEST, VERBS

#: Keys under which an SDK is pinned to a version.
PINS = ("apiVersion", "api_version", "Stripe-Version", "version", "anthropic-version")
#: After these a slash begins a pattern, and < an element.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "default", "instanceof"}
KEYWORDS = BEFORE_VALUE | {"if", "for", "while", "switch", "catch", "function", "class", "const", "let", "var", "import", "export", "from", "as", "async", "with", "super"}
SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S)
NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_$][\w$]*")
NUMBER = re.compile(r"\d[\w.]*|\.\d[\w]*")
PUNCT = re.compile(r"\?\.(?!\d)|=>|\.\.\.|[=!]==?|&&|\|\||\?\?|\*\*|\+\+|--|<<|>>>?|[<>]=|.", re.S)
TAG = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>]))")


class Unreadable(ValueError):
    pass


class Tokens:
    """Streams of (kind, text, line); kinds are name, text (with {} for holes), number, pattern and sign."""

    def __init__(self, source: str):
        self.s = source
        self.streams: list[list[tuple[str, str, int]]] = []
        self.read(0, len(source))

    def line(self, at: int) -> int:
        return self.s.count("\n", 0, at) + 1

    def fail(self, what: str, at: int):
        raise Unreadable(f"{what} that does not end, from line {self.line(at)}")

    def read(self, at: int, end: int | None = None) -> int:
        """Reads a stream from at: to end, or to the } that closes what it is in; returns where it stopped."""
        s, out, depth = self.s, [], 0
        self.streams.append(out)
        line, counted = self.line(at), at
        while True:
            if m := SPACE.match(s, at):
                at = m.end()
            if at >= len(s) or end is not None and at >= end:
                if end is None:
                    self.fail("an expression", counted)
                return at
            if s.startswith("/*", at):
                self.fail("a comment", at)
            line, counted = line + s.count("\n", counted, at), at
            c = s[at]
            if end is None and c == "}" and not depth:
                return at
            value = not out or out[-1][0] == "sign" and out[-1][1] not in (")", "]", "}") or out[-1][1] in BEFORE_VALUE and out[-1][0] == "name"
            if c in "\"'":
                at, text = self.string(at, c)
                out.append(("text", text, line))
            elif c == "`":
                at, text = self.template(at)
                out.append(("text", text, line))
            elif c == "/" and (value or out and out[-1][1] == "}"):
                at = self.pattern(at)
                out.append(("pattern", "", line))
            elif c == "<" and value and TAG.match(s, at):
                at = self.element(at)
                out.append(("text", "", line))
            elif m := NAME.match(s, at):
                out.append(("name", m.group(), line))
                at = m.end()
            elif m := NUMBER.match(s, at):
                out.append(("number", m.group(), line))
                at = m.end()
            else:
                m = PUNCT.match(s, at)
                depth += (c in "{[(") - (c in "}])")
                out.append(("sign", m.group(), line))
                at = m.end()

    def string(self, at: int, quote: str) -> tuple[int, str]:
        begin, out = at, []
        at += 1
        while at < len(self.s):
            c = self.s[at]
            if c == "\\":
                out.append(self.s[at + 1 : at + 2])
                at += 2
            elif c == quote:
                return at + 1, "".join(out)
            elif c == "\n":
                break
            else:
                out.append(c)
                at += 1
        self.fail("a string", begin)

    def template(self, at: int) -> tuple[int, str]:
        begin, out = at, []
        at += 1
        while at < len(self.s):
            if self.s[at] == "\\":
                out.append(self.s[at + 1 : at + 2])
                at += 2
            elif self.s[at] == "`":
                return at + 1, "".join(out)
            elif self.s.startswith("${", at):
                out.append("{}")
                at = self.read(at + 2) + 1
            else:
                out.append(self.s[at])
                at += 1
        self.fail("a template", begin)

    def pattern(self, at: int) -> int:
        begin, group = at, False
        at += 1
        while at < len(self.s) and self.s[at] != "\n":
            c = self.s[at]
            if c == "\\":
                at += 1
            elif c == "[":
                group = True
            elif c == "]":
                group = False
            elif c == "/" and not group:
                while at + 1 < len(self.s) and self.s[at + 1].isalpha():
                    at += 1
                return at + 1
            at += 1
        self.fail("a pattern", begin)

    def element(self, at: int) -> int:
        """Passes over an element with its children; what stands in { } is read, text is not."""
        begin, s = at, self.s
        at = TAG.match(s, at).end()
        if s[at - 1] != ">":
            while True:
                if at >= len(s):
                    self.fail("an element", begin)
                if s.startswith("/>", at):
                    return at + 2
                c = s[at]
                if c == ">":
                    at += 1
                    break
                if c in "\"'":
                    closed = s.find(c, at + 1)
                    if closed < 0:
                        self.fail("an attribute", begin)
                    at = closed + 1
                elif c == "{":
                    at = self.read(at + 1) + 1
                else:
                    at += 1
        while at < len(s):
            if s.startswith("</", at):
                closed = s.find(">", at)
                if closed < 0:
                    break
                return closed + 1
            if s[at] == "{":
                at = self.read(at + 1) + 1
            elif s[at] == "<" and TAG.match(s, at):
                at = self.element(at)
            else:
                at += 1
        self.fail("an element", begin)


class File:
    def __init__(self, source: str):
        self.streams = Tokens(source).streams
        self.lines = source.splitlines()
        self.modules: dict[str, str] = {}
        self.came: dict[str, tuple[str, tuple[str, ...]]] = {}  # name: the root it was made from, and texts on the way
        self.rows: list[dict] = []
        for t in self.streams:
            self.imports(t)
        for t in self.streams:
            self.calls(t)
        for t in self.streams:
            self.reads(t)
            self.pins(t)

    def row(self, line: int, fact: str, **more) -> None:
        self.rows.append({"fact": fact, "line": line, "text": self.lines[line - 1].strip()[:160] if 0 < line <= len(self.lines) else ""} | more)

    @staticmethod
    def names_in(t, at: int) -> tuple[list[tuple[str, str]], int]:
        """(name there, name here) of { a, b as c, d: e }, and where it ends; at is the {."""
        out, at = [], at + 1
        while at < len(t) and t[at][1] != "}":
            if t[at][0] in ("name", "text"):
                there = here = t[at][1]
                if at + 2 < len(t) and t[at + 1][1] in ("as", ":") and t[at + 2][0] == "name":
                    here, at = t[at + 2][1], at + 2
                if there != "type" or here != there:
                    out.append((there, here))
            elif t[at][1] in "{[(":
                return out, at
            at += 1
        return out, at

    def imports(self, t) -> None:
        for k, (kind, text, line) in enumerate(t):
            if (kind, text) == ("name", "import") and k + 1 < len(t) and t[k + 1][1] != "(":
                names, at = [], k + 1
                while at < len(t) and t[at][0] != "text" and at < k + 400 and t[at][1] != ";":
                    if t[at][1] == "{":
                        found, at = self.names_in(t, at)
                        names += [here for _, here in found]
                    elif t[at][0] == "name" and t[at][1] not in ("from", "as", "type", "default"):
                        names.append(t[at][1])
                    at += 1
                if at < len(t) and t[at][0] == "text":
                    for n in names or [""]:
                        self.bind(line, n, t[at][1])
            if (kind, text) in (("name", "require"), ("name", "import")) and k + 2 < len(t) and t[k + 1][1] == "(" and t[k + 2][0] == "text":
                targets, _ = self.target(t, k)
                for n in targets or [""]:
                    self.bind(line, n, t[k + 2][1])

    def bind(self, line: int, name: str, module: str) -> None:
        if name:
            self.modules[name] = module
        self.row(line, "import", target=name, module=module)

    def target(self, t, at: int) -> tuple[list[str], list[tuple[str, str]]]:
        """Names that the expression at gets: of x = ..., or there and here of { a, b: c } = ..."""
        k = at - 1
        while k >= 0 and t[k][1] in ("await", "new", "("):
            k -= 1
        if k < 1 or t[k][1] != "=":
            return [], []
        k -= 1
        if t[k][1] == "}":
            first = k
            while first >= 0 and t[first][1] != "{":
                first -= 1
            found, _ = self.names_in(t, max(first, 0))
            return [here for _, here in found], found
        while k > 0 and t[k][0] == "name" and t[k - 1][1] in ("|", ":", "<", ">", "."):  # a type
            if t[k - 1][1] == ".":
                break
            k -= 2
        return ([t[k][1]] if t[k][0] == "name" else []), []

    @staticmethod
    def chain_back(t, at: int) -> tuple[list[str], int]:
        """The names of a.b?.c that ends at, and where it begins."""
        out = []
        while at >= 0:
            if t[at][0] == "name" and (t[at][1] not in KEYWORDS or out and t[at + 1][1] in (".", "?.")):
                out.append(t[at][1])
                if at and t[at - 1][1] in (".", "?."):
                    at -= 2
                    continue
                return out[::-1], at
            if t[at][1] == "]" and at >= 2 and t[at - 1][0] == "text" and t[at - 2][1] == "[":
                out.append(t[at - 1][1])
                at -= 3
                continue
            break
        return out[::-1], at + 1

    @staticmethod
    def closing(t, at: int) -> int:
        depth = 0
        for k in range(at, len(t)):
            if t[k][0] == "sign":
                depth += (t[k][1] in "{[(") - (t[k][1] in "}])")
                if not depth:
                    return k
        return len(t)

    def origins(self, root: str, hops: int = HOPS) -> set[str]:
        out = {f"name:{root.lower()}"}
        if root in self.modules:
            out.add(f"module:{self.modules[root].lower()}")
        if hops and root in self.came:
            before, texts = self.came[root]
            out |= {f"text:{x.lower()[:LONGEST]}" for x in texts if "." in x} | (self.origins(before, hops - 1) if before != root else set())
        return out

    def calls(self, t) -> None:
        for k, (kind, text, line) in enumerate(t):
            if (kind, text) != ("sign", "(") or not k:
                continue
            chain, begin = self.chain_back(t, k - 1)
            if not chain or chain[0] in KEYWORDS or begin and t[begin - 1][1] in ("function", "class"):
                continue
            end = self.closing(t, k)
            inside = t[k + 1 : end]
            keys = [x[1] for x, y in zip(inside, inside[1:], strict=False) if x[0] in ("name", "text") and y[1] == ":"]
            keys += [y[1] for x, y, z in zip(inside, inside[1:], [*inside[2:], ("sign", "", 0)], strict=False) if x[1] in ("{", ",") and y[0] == "name" and z[1] in (",", "}")]
            strings = [x[1][:LONGEST] for x in inside if x[0] == "text" and x[1]]
            said = [z[1].lower() for x, y, z in zip(inside, inside[1:], inside[2:], strict=False) if x[1] == "method" and y[1] == ":" and z[0] == "text"]
            last = chain[-1].lower()
            methods = set(said) or {last} & set(VERBS) or ({"get"} if chain == ["fetch"] else set())
            new = bool(begin) and t[begin - 1][1] == "new"
            targets, parts = self.target(t, begin)
            for n in targets:
                self.came[n] = (chain[0], tuple(strings))
            at = dict(chain=".".join(chain), target=targets[0] if len(targets) == 1 else None, keys=sorted(set(keys)), strings=sorted(set(strings)), methods=sorted(methods))
            texts = {f"text:{x.lower()}" for x in strings if "." in x}
            registers = chain[0] in ("app", "router", "server") and last in (*VERBS, "use", "all", "route")
            self.row(line, "construct" if new else "call", **at, origins=sorted(self.origins(chain[0]) | texts), registers=registers)
            for there, _ in parts:
                self.row(line, "read", chain=chain[0], position=[there], origins=sorted(self.origins(chain[0]) | texts))

    def reads(self, t) -> None:
        k = 0
        while k < len(t):
            starts = t[k][0] == "name" and t[k][1] not in KEYWORDS - {"super"} and not (k and t[k - 1][1] in (".", "?."))
            if not starts:
                if t[k][1] == "{" and k and t[k - 1][1] in ("const", "let", "var"):
                    found, end = self.names_in(t, k)
                    if end + 2 < len(t) and t[end][1] == "}" and t[end + 1][1] == "=":
                        base, at = t[end + 2], end + 2
                        if base[0] == "name" and base[1] not in KEYWORDS and (at + 1 >= len(t) or t[at + 1][1] not in ("(", ".", "?.")):
                            for there, here in found:
                                self.row(t[k][2], "read", chain=base[1], position=[there], origins=sorted(self.origins(base[1])))
                                self.came.setdefault(here, (base[1], ()))
                k += 1
                continue
            path, at = [t[k][1]], k + 1
            while at + 1 < len(t):
                if t[at][1] in (".", "?.") and t[at + 1][0] == "name":
                    path.append(t[at + 1][1])
                    at += 2
                elif t[at][1] == "[" and t[at + 1][0] in ("text", "number") and at + 2 < len(t) and t[at + 2][1] == "]":
                    path += [t[at + 1][1]] if t[at + 1][0] == "text" else []
                    at += 3
                else:
                    break
            if at < len(t) and t[at][1] == "(":
                path = path[:-1]
            if len(path) > 1 and not (at < len(t) and t[at][1] == "="):
                self.row(t[k][2], "read", chain=path[0], position=path[1:], origins=sorted(self.origins(path[0])))
            k = max(at, k + 1)

    def pins(self, t) -> None:
        for (_, key, line), colon, value in zip(t, t[1:], t[2:], strict=False):
            if key in PINS and colon[1] == ":" and value[0] == "text" and value[1]:
                self.row(line, "pin", target=key, module=value[1])


def facts(source: str) -> list[dict]:
    return File(source).rows
