"""A parser of R source, as far as definitions and calls need it: precedence climbing over tokens."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from loomgraph.schema import MASKING, PRIMITIVES


class ParseError(ValueError):
    pass


@dataclass
class Token:
    kind: str  # num str sym op nl end
    text: str
    line: int


@dataclass
class Node:
    kind: str  # num str sym call fun block if loop index member paren missing
    text: str = ""
    head: "Node | None" = None
    args: list[tuple[str, "Node"]] = field(default_factory=list)
    line: int = 0
    end: int = 0


_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r\f ]+)|(?P<comment>\#[^\n]*)|(?P<nl>\n|;)|(?P<raw>[rR](?:"|')(?P<dash>-*)(?P<open>[\(\[\{]))|(?P<str>"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*')|(?P<tick>`(?:[^`\\]|\\.)*`)
|(?P<num>0[xX][0-9a-fA-F]+[Li]?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[Li]?)|(?P<sym>(?:[^\W\d_]|\.(?![0-9]))[\w.]*)
|(?P<op>%[^%\n]*%|<<-|->>|:::|\|>|<-|->|<=|>=|==|!=|&&|\|\||::|:=|\[\[|\\|[-+*/^~?!<>&|=:$@(){}\[\],])""",
    re.X,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
BINARY = {"?": (1, 2), "=": (4, 3), "<-": (6, 5), "<<-": (6, 5), ":=": (6, 5), "->": (7, 8), "->>": (7, 8), "~": (9, 10), "||": (11, 12), "|": (11, 12), "&&": (13, 14), "&": (13, 14), "==": (17, 18), "!=": (17, 18), "<": (17, 18), ">": (17, 18), "<=": (17, 18), ">=": (17, 18), "+": (19, 20), "-": (19, 20), "*": (21, 22), "/": (21, 22), "|>": (23, 24), ":": (25, 26), "^": (30, 29)}
UNARY = {"-": 27, "+": 27, "!": 15, "~": 9, "?": 1}


def tokens(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"line {line}: {text[at : at + 20]!r}")
        kind, raw = m.lastgroup, m.group()
        if m.group("raw"):
            close = _CLOSE[m.group("open")] + m.group("dash") + m.group("raw")[1]
            end = text.find(close, m.end())
            if end < 0:
                raise ParseError(f"line {line}: raw string")
            raw = text[at : end + len(close)]
            out.append(Token("str", text[m.end() : end], line))
        elif m.group("str"):
            out.append(Token("str", raw[1:-1], line))
        elif m.group("tick"):
            out.append(Token("sym", raw[1:-1], line))
        elif kind in ("num", "sym", "op", "nl"):
            out.append(Token("nl" if kind == "nl" else kind, raw, line))
        at += len(raw)
        line += raw.count("\n")
    out.append(Token("end", "", line))
    return out


class Parser:
    def __init__(self, text: str):
        self.ts, self.i, self.deep = tokens(text), 0, [False]

    def skip(self) -> None:
        while self.ts[self.i].kind == "nl":
            self.i += 1

    def peek(self) -> Token:
        if self.deep[-1]:
            self.skip()
        return self.ts[self.i]

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def expect(self, text: str) -> Token:
        t = self.next()
        if t.kind != "op" or t.text != text:
            raise ParseError(f"line {t.line}: {text} expected, {t.text!r} found")
        return t

    def program(self) -> list[Node]:
        out = []
        while True:
            self.skip()
            if self.ts[self.i].kind == "end":
                return out
            out.append(self.expression(0))
            if self.ts[self.i].kind not in ("nl", "end"):
                raise ParseError(f"line {self.ts[self.i].line}: {self.ts[self.i].text!r}")

    def expression(self, least: int) -> Node:
        self.skip()
        left = self.prefix()
        while True:
            t = self.peek()
            if t.kind != "op":
                return left
            op = t.text
            if op in ("(", "[", "[["):
                if least > 40:
                    return left
                self.next()
                close = {"(": ")", "[": "]", "[[": "]"}[op]
                args = self.arguments(close)
                end = self.ts[self.i - 1].line
                if op == "[[":
                    end = self.expect("]").line
                left = Node("call" if op == "(" else "index", head=left, args=args, line=left.line, end=end)
                continue
            if op in ("$", "@", "::", ":::"):
                self.next()
                self.skip()
                right = self.prefix(member=True)
                left = Node("member", op, args=[("", left), ("", right)], line=left.line, end=right.end)
                continue
            if op.startswith("%"):
                power = (23, 24)
            elif op in BINARY:
                power = BINARY[op]
            else:
                return left
            if power[0] < least:
                return left
            self.next()
            right = self.expression(power[1])
            if op in ("->", "->>"):
                op, left, right = "<-", right, left
                left.line, left.end = min(left.line, right.line), max(left.end, right.end)
            left = Node("call", head=Node("sym", op), args=[("", left), ("", right)], line=min(left.line, right.line), end=max(left.end, right.end))

    def arguments(self, close: str) -> list[tuple[str, Node]]:
        self.deep.append(True)
        out: list[tuple[str, Node]] = []
        while True:
            t = self.peek()
            if t.kind == "op" and t.text == close:
                self.deep.pop()
                self.i += 1
                return out
            if t.kind == "op" and t.text == ",":
                self.i += 1
                continue
            name = ""
            if t.kind in ("sym", "str"):
                j = self.i + 1
                while self.ts[j].kind == "nl":
                    j += 1
                if self.ts[j].kind == "op" and self.ts[j].text == "=":
                    name, self.i = t.text, j + 1
                    after = self.peek()
                    if after.kind == "op" and after.text in (",", close):
                        out.append((name, Node("missing", line=t.line, end=t.line)))
                        continue
            out.append((name, self.expression(5)))
            t = self.peek()
            if not (t.kind == "op" and t.text in (",", close)):
                raise ParseError(f"line {t.line}: {t.text!r} among arguments")

    def prefix(self, member: bool = False) -> Node:
        t = self.next()
        if t.kind in ("num", "str"):
            return Node(t.kind, t.text, line=t.line, end=t.line + (t.text.count("\n") if t.kind == "str" else 0))
        if t.kind == "sym":
            if not member:
                if t.text == "function":
                    return self.function(t)
                if t.text == "if":
                    return self.branch(t)
                if t.text in ("for", "while"):
                    self.expect("(")
                    self.deep.append(True)
                    parts = []
                    if t.text == "for":
                        parts.append(("", Node("sym", self.next().text, line=t.line, end=t.line)))
                        self.next()
                    parts.append(("", self.expression(0)))
                    self.peek()
                    self.deep.pop()
                    self.expect(")")
                    body = self.expression(3)
                    return Node("loop", t.text, args=[*parts, ("", body)], line=t.line, end=body.end)
                if t.text == "repeat":
                    body = self.expression(3)
                    return Node("loop", t.text, args=[("", body)], line=t.line, end=body.end)
            return Node("sym", t.text, line=t.line, end=t.line)
        if t.kind == "op":
            if t.text == "\\":
                return self.function(t)
            if t.text == "(":
                self.deep.append(True)
                inner = self.expression(0)
                self.peek()
                self.deep.pop()
                end = self.expect(")").line
                return Node("paren", args=[("", inner)], line=t.line, end=end)
            if t.text == "{":
                self.deep.append(False)
                parts = []
                while True:
                    self.skip()
                    u = self.ts[self.i]
                    if u.kind == "op" and u.text == "}":
                        self.deep.pop()
                        self.i += 1
                        return Node("block", args=parts, line=t.line, end=u.line)
                    parts.append(("", self.expression(0)))
                    u = self.ts[self.i]
                    if u.kind != "nl" and not (u.kind == "op" and u.text == "}"):
                        raise ParseError(f"line {u.line}: {u.text!r}")
            if t.text in UNARY:
                inner = self.expression(UNARY[t.text])
                return Node("call", head=Node("sym", t.text), args=[("", inner)], line=t.line, end=inner.end)
        raise ParseError(f"line {t.line}: {t.text!r}")

    def function(self, t: Token) -> Node:
        self.skip()
        self.expect("(")
        formals = []
        self.deep.append(True)
        while True:
            u = self.next()
            if u.kind == "op" and u.text == ")":
                break
            if u.kind == "op" and u.text == ",":
                continue
            if u.kind != "sym":
                raise ParseError(f"line {u.line}: {u.text!r} among formals")
            default = Node("missing")
            if self.peek().kind == "op" and self.peek().text == "=":
                self.next()
                default = self.expression(5)
            formals.append((u.text, default))
        self.deep.pop()
        body = self.expression(3)
        return Node("fun", args=[*formals, ("", body)], line=t.line, end=body.end)

    def branch(self, t: Token) -> Node:
        self.expect("(")
        self.deep.append(True)
        test = self.expression(0)
        self.peek()
        self.deep.pop()
        self.expect(")")
        then = self.expression(3)
        parts, at = [("", test), ("", then)], self.i
        if len(self.deep) > 1:
            self.skip()
        u = self.ts[self.i]
        if u.kind == "sym" and u.text == "else":
            self.i += 1
            parts.append(("", self.expression(3)))
        else:
            self.i = at
        return Node("if", args=parts, line=t.line, end=parts[-1][1].end)


def parse(text: str) -> list[Node]:
    return Parser(text).program()


def walk(node: Node):
    yield node
    if node.head is not None:
        yield from walk(node.head)
    for _, a in node.args:
        yield from walk(a)


def _name(node: Node | None) -> str | None:
    return node.text if node is not None and node.kind in ("sym", "str") else None


def find_calls(body: Node) -> list[str]:
    """Names in the place of functions, without primitives, local functions and column names; qualified names whole."""
    used, local, columns, qualified = set(), set(), set(), set()
    for n in walk(body):
        if n.kind == "call" and n.head is not None:
            if n.head.kind == "sym":
                used.add(n.head.text)
                if n.head.text in ("<-", "=", "<<-") and len(n.args) == 2 and n.args[0][1].kind == "sym" and n.args[1][1].kind == "fun":
                    local.add(n.args[0][1].text)
            verb = _name(n.head) or (_name(n.head.args[1][1]) if n.head.kind == "member" and n.head.text in ("::", ":::") else None)
            if verb in MASKING:
                columns |= {a.text for _, a in n.args if a.kind == "sym"}
            if verb in ("enquo", "sym", "as_name", "ensym") and n.args and n.args[0][1].kind == "sym":
                columns.add(n.args[0][1].text)
        if n.kind == "member":
            a, b = n.args[0][1], n.args[1][1]
            if n.text in ("::", ":::"):
                if _name(a) and _name(b):
                    qualified.add(f"{a.text}::{b.text}")
            elif a.kind == "sym" and a.text == ".data" and _name(b):
                columns.add(b.text)
        if n.kind == "block" and len(n.args) == 1 and n.args[0][1].kind == "block" and len(n.args[0][1].args) == 1 and n.args[0][1].args[0][1].kind == "sym":
            columns.add(n.args[0][1].args[0][1].text)
    plain = {u for u in used - local - PRIMITIVES - columns if not u.startswith(".data")}
    return sorted(plain | qualified)


_BRANCH = re.compile(r"\b(if|for|while|repeat|tryCatch|switch)\b")


def _record(path: str, lines: list[str], name: str, node: Node, fun: Node | None) -> dict:
    begin, end = node.line, node.end
    body = "\n".join(lines[begin - 1 : end])
    at = begin - 2
    while at >= 0 and re.match(r"\s*#'", lines[at]):
        at -= 1
    formals = [n for n, _ in fun.args[:-1]] if fun is not None else None
    parent, stem = os.path.basename(os.path.dirname(path)), os.path.splitext(os.path.basename(path))[0]
    return {
        "id": f"{parent}/{stem}::{name}", "name": name, "file": path, "line_start": begin, "line_end": end, "signature": f"{name}({', '.join(formals)})" if formals is not None else name,
        "body_text": body, "roxygen_text": "\n".join(lines[at + 1 : begin - 1]), "complexity": 1 + len(_BRANCH.findall(body)), "calls_list": find_calls(fun.args[-1][1] if fun is not None else node), "scope_level": 0,
    }


def extract(path: str, text: str) -> list[dict]:
    """Records of the top-level definitions of a file; none where it can't be parsed."""
    try:
        program = parse(text)
    except (ParseError, RecursionError):
        return []
    lines, out = text.split("\n"), []
    for n in program:
        if n.kind != "call" or n.head is None or n.head.kind != "sym":
            continue
        if n.head.text in ("<-", "=", "<<-") and len(n.args) == 2:
            name, value = _name(n.args[0][1]), n.args[1][1]
            if name and value.kind == "fun":
                out.append(_record(path, lines, name, n, value))
            elif name and value.kind == "call" and (_name(value.head) == "R6Class" or value.head.kind == "member" and _name(value.head.args[1][1]) == "R6Class"):
                for part, members in value.args:
                    if part in ("public", "private", "active") and members.kind == "call" and _name(members.head) == "list":
                        out += [_record(path, lines, f"{name}${m}", n, f) for m, f in members.args if f.kind == "fun"]
        elif n.head.text in ("setGeneric", "setMethod", "setClass") and n.args and n.args[0][1].kind in ("str", "sym"):
            fun = next((a for _, a in n.args[1:] if a.kind == "fun"), None)
            out.append(_record(path, lines, n.args[0][1].text, n, fun) | {"signature": n.args[0][1].text})
    return out


def symbols_called(text: str) -> list[str]:
    """All names called anywhere in a file."""
    try:
        program = parse(text)
    except (ParseError, RecursionError):
        return []
    return sorted({s for n in program for s in find_calls(n)})
