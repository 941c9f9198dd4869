"""Symbols, references and chunks from Java, JavaScript and TypeScript texts.

A scanner over lexical tokens follows brackets and recognises declarations; it
builds no syntax tree. `extract` gives one tagged row per fact, so that a text is
read once. Known gaps: names built at run time, declarations inside regular
expressions the lexer takes for a division, and overloads told apart by types only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Fact(NamedTuple):
    tag: str
    """symbol, call, import, heritage or chunk"""
    name: str
    kind: str
    start_line: int
    end_line: int
    parent: str | None = None
    text: str | None = None
    extra: str | None = None


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


_PIECES = r'''\s*(?:(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))%s
    |(?P<string>\"\"\"(?:\\.|[^\\])*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<tick>`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)
    |(?P<op>=>|\.\.\.|::|->|\S)|(?P<end>\Z))'''
_REGEX = r"|(?P<regex>/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
_LEX_DIVIDE = re.compile(_PIECES % "", re.S | re.X)
_LEX_REGEX = re.compile(_PIECES % _REGEX, re.S | re.X)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_CONDITIONS = frozenset(["if", "while", "for"])
_BEFORE_VALUES = frozenset("return case typeof in of throw delete void do else instanceof".split())
_IN_TYPES = frozenset("< > , . [ ] | & ? : { } ( ) => ;".split())
_NOT_CALLS = frozenset("if for while switch catch return throw new typeof await super this function synchronized else do try in of "
                       "instanceof case void delete yield assert import async".split())
_JAVA_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_ES_MODIFIERS = frozenset("public protected private static abstract readonly override declare async get set accessor".split())
_JAVA_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "CLASS"}


def tokenize(text: str) -> tuple[list[Token], list[list[Token]]]:
    """Tokens without comments, and those of each expression inside a template; a template itself is one token."""
    ends = [m.start() for m in re.finditer("\n", text)]
    inner: list[list[Token]] = []

    def scan(at: int, nested: bool) -> tuple[list[Token], int]:
        out: list[Token] = []
        value, depth, parens = False, 0, []
        while at < len(text):
            m = (_LEX_DIVIDE if value else _LEX_REGEX).match(text, at)
            kind, before = m.lastgroup, at
            start, at = m.start(kind), m.end()
            if kind in ("comment", "end"):
                continue
            word = m.group(kind)
            if kind == "op":
                depth += (word == "{") - (word == "}")
                if nested and depth < 0:
                    return out, at
                if word == "(":
                    parens.append(bool(out) and out[-1].text in _CONDITIONS)
                value = word in ("]", "}") or word == ")" and not (parens and parens.pop())
            elif kind == "tick":
                while True:
                    at = _TEMPLATE.match(text, at).end()
                    if not text.startswith("${", at):
                        break
                    tokens, at = scan(at + 2, True)
                    inner.append(tokens)
                at = min(at + 1, len(text))
                kind, word, value = "string", text[start:at], True
            else:
                value = kind != "name" or word not in _BEFORE_VALUES
            out.append(Token(kind, word, bisect_left(ends, start) + 1, start, at))
            if at == before:
                at += 1
        return out, at

    return scan(0, False)[0], inner


def _after_type_arguments(tokens: list[Token], i: int) -> int:
    """Index behind the '>' of type arguments that begin at i; i itself if what follows is none."""
    depth, j = 0, i
    while j < len(tokens):
        t = tokens[j]
        depth += (t.text == "<") - (t.text == ">")
        j += 1
        if depth == 0:
            return j
        doubled = t.text in ("&", "|") and tokens[j - 2].text == t.text
        if t.kind == "number" or doubled or t.kind == "op" and t.text not in _IN_TYPES:
            return i
    return i


class _Scanner:
    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens, self.inner = tokenize(text)
        self.facts: list[Fact] = []
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op":
                if t.text in "([{":
                    stack.append(i)
                elif t.text in ")]}" and stack:
                    j = stack.pop()
                    self.partner[j], self.partner[i] = i, j

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def close(self, i: int) -> int:
        return self.partner.get(i, len(self.tokens) - 1)

    def last_line(self, i: int) -> int:
        t = self.tokens[min(i, len(self.tokens) - 1)]
        return t.line + t.text.count("\n")

    def signature(self, a: int, b: int) -> str:
        """Source text of tokens a to b (exclusive), white space folded."""
        return re.sub(r"\s+", " ", self.text[self.tokens[a].start:self.tokens[b - 1].end]).strip() if b > a else ""

    def add(self, tag: str, name: str, kind: str, a: int, b: int, parent: str | None = None, text: str | None = None, extra: str | None = None) -> None:
        self.facts.append(Fact(tag, name, kind, self.tokens[a].line, self.last_line(b), parent, text, extra))

    def skip_angles(self, i: int) -> int:
        depth = 0
        while i < len(self.tokens):
            t = self.at(i)
            depth += t == "<"
            depth -= t == ">"
            i += 1
            if depth <= 0:
                return i
            if t in ("{", ";"):
                return i
        return i

    def type_names(self, a: int, b: int) -> list[str]:
        """Outermost type names of a list, generic arguments dropped, the last part of qualified names."""
        names, depth, last = [], 0, None
        for i in range(a, b):
            t = self.at(i)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif depth == 0 and t == ",":
                if last:
                    names.append(last)
                last = None
            elif depth == 0 and self.is_name(i):
                last = t
        return [*names, last] if last else names

    def calls(self, declared: set[int]) -> None:
        """Calls by name, over type arguments where there are some, in templates too."""
        for tokens, known in [(self.tokens, declared), *[(t, set()) for t in self.inner]]:
            for i, t in enumerate(tokens):
                if t.kind != "name" or t.text in _NOT_CALLS or i in known or i and tokens[i - 1].text in ("new", "function", "@"):
                    continue
                j = i + 1
                if j < len(tokens) and tokens[j].text == "<":
                    j = _after_type_arguments(tokens, j)
                if j >= len(tokens) or tokens[j].text != "(":
                    continue
                first = i
                while first >= 2 and tokens[first - 1].text == "." and tokens[first - 2].kind == "name":
                    first -= 2
                if not first or tokens[first - 1].text not in ("new", "@"):
                    self.facts.append(Fact("call", t.text, "CALLS", t.line, t.line))

    # --- Java -------------------------------------------------------------------
    def java(self) -> None:
        self.declared: set[int] = set()
        i = 0
        while i < len(self.tokens):
            if self.at(i) == "import":
                j = i + 1
                static = self.at(j) == "static"
                while j < len(self.tokens) and self.at(j) != ";":
                    j += 1
                path = "".join(t.text for t in self.tokens[i + 1 + static:j])
                if not static and not path.endswith("*") and path:
                    self.add("import", path.rsplit(".", 1)[-1], "NAMED", i, j, text=path)
                i = j
            i += 1
        self.java_members(0, len(self.tokens), None, None)
        self.calls(self.declared)

    def java_members(self, i: int, end: int, owner: str | None, owner_kind: str | None) -> None:
        if owner_kind == "ENUM":
            while i < end and self.at(i) != ";":
                if self.is_name(i) and self.at(i - 1) in ("{", ","):
                    self.declared.add(i)
                if self.at(i) == "{":
                    self.java_members(i + 1, self.close(i), owner, "CLASS")
                i = self.close(i) + 1 if self.at(i) in ("(", "{", "[") else i + 1
        while i < end:
            first = i
            while i < end:
                if self.at(i) == "@" and self.at(i + 1) != "interface":
                    i += 2
                    while self.at(i) == ".":
                        i += 2
                    if self.at(i) == "(":
                        i = self.close(i) + 1
                elif self.at(i) in _JAVA_MODIFIERS or self.at(i) == "non" and self.at(i + 2) == "sealed":
                    i += 3 if self.at(i) == "non" else 1
                else:
                    break
            t = self.at(i)
            if t in (";", "}"):
                i += 1
            elif t == "{":
                self.java_body(i + 1, self.close(i), owner)
                i = self.close(i) + 1
            elif t in _JAVA_TYPES and self.is_name(i + 1) and (t != "record" or self.at(i + 2) in ("(", "<")) or t == "@" and self.at(i + 1) == "interface":
                i = self.java_type(first, i, end, owner)
            elif t in ("package", "import"):
                while i < end and self.at(i) != ";":
                    i += 1
            else:
                i = self.java_member(first, i, end, owner)

    def java_type(self, first: int, i: int, end: int, owner: str | None) -> int:
        kind = "INTERFACE" if self.at(i) == "@" else _JAVA_TYPES[self.at(i)]
        i += 2 if self.at(i) == "@" else 1
        name = self.at(i)
        self.declared.add(i)
        j = i + 1
        if self.at(j) == "<":
            j = self.skip_angles(j)
        if self.at(j) == "(":
            j = self.close(j) + 1
        head = j
        while j < end and self.at(j) not in ("{", ";"):
            j += 1
        marks = [k for k in range(head, j) if self.at(k) in ("extends", "implements", "permits")] + [j]
        for k, stop in zip(marks, marks[1:]):
            if self.at(k) != "permits":
                relation = "EXTENDS" if self.at(k) == "extends" else "IMPLEMENTS"
                for target in self.type_names(k + 1, stop):
                    self.add("heritage", target, relation, i, i, name, extra=kind)
        last = self.close(j) if self.at(j) == "{" else j
        self.add("symbol", name, kind, first, last, owner, self.signature(first, j))
        if self.at(j) == "{":
            self.java_members(j + 1, last, name, kind)
        return last + 1

    def java_member(self, first: int, i: int, end: int, owner: str | None) -> int:
        if self.at(i) == "<":
            i = self.skip_angles(i)
        j = i
        while j < end and self.at(j) not in ("(", ";", "=", "{", "}"):
            if self.at(j) == "<":
                j = self.skip_angles(j)
                continue
            if self.at(j) == "[":
                j = self.close(j) + 1
                continue
            if self.at(j) == ",":
                break
            j += 1
        if j >= end:
            return end
        if self.at(j) == "(" and self.is_name(j - 1):
            name, close = self.at(j - 1), self.close(j)
            self.declared.add(j - 1)
            body = close + 1
            while body < end and self.at(body) not in ("{", ";"):
                body += 1
            last = self.close(body) if self.at(body) == "{" else body
            kind = "CONSTRUCTOR" if name == owner and j - 1 == i else "METHOD"
            self.add("symbol", name, kind, first, min(last, end), owner, self.signature(first, min(body, end)))
            if self.at(body) == "{":
                self.java_body(body + 1, last, owner)
            return last + 1
        if self.at(j) == "{":
            if self.is_name(j - 1) and self.at(j - 1) == owner and j - 1 == i:
                self.add("symbol", owner, "CONSTRUCTOR", first, self.close(j), owner, self.signature(first, j))
            self.java_body(j + 1, self.close(j), owner)
            return self.close(j) + 1
        if self.at(j) == "}":
            return j + 1
        # fields: declarators up to the semicolon at this depth
        stop, starts, k = j, [j - 1], j
        while k < end and self.at(k) != ";":
            if self.at(k) in ("(", "[", "{"):
                if self.at(k) == "{":
                    self.java_body(k + 1, self.close(k), owner)
                k = self.close(k) + 1
                continue
            if self.at(k) == "," and self.is_name(k + 1) and self.at(k + 2) in (",", "=", ";", "["):
                starts.append(k + 1)
            k += 1
        stop = min(k, end - 1)
        text = self.signature(first, stop)
        for n, s in enumerate(starts):
            while s > first and not self.is_name(s):
                s -= 1
            last = starts[n + 1] - 2 if n + 1 < len(starts) else stop - 1
            if self.is_name(s) and s > i:
                self.add("symbol", self.at(s), "FIELD", s, max(s, last), owner, text)
        return stop + 1

    def java_body(self, i: int, end: int, owner: str | None) -> None:
        """Local and anonymous classes inside code."""
        while i < end:
            t = self.at(i)
            if t in ("class", "interface", "enum") and self.is_name(i + 1) and self.at(i - 1) != ".":
                i = self.java_type(i, i, end, owner)
                continue
            if t == "record" and self.is_name(i + 1) and self.at(i + 2) in ("(", "<"):
                i = self.java_type(i, i, end, owner)
                continue
            if t == "new" and self.is_name(i + 1):
                j = i + 1
                while self.is_name(j) or self.at(j) in (".",):
                    j += 1
                if self.at(j) == "<":
                    j = self.skip_angles(j)
                if self.at(j) == "(" and self.at(self.close(j) + 1) == "{":
                    body = self.close(j) + 1
                    self.java_body(j + 1, self.close(j), owner)
                    self.java_members(body + 1, self.close(body), owner, "CLASS")
                    i = self.close(body) + 1
                    continue
            i += 1

    # --- JavaScript and TypeScript ------------------------------------------------
    def ecmascript(self) -> None:
        self.declared = set()
        self.imports()
        self.es_code(0, len(self.tokens), None)
        self.calls(self.declared)

    def imports(self) -> None:
        i = 0
        while i < len(self.tokens):
            if self.at(i) == "import" and self.at(i + 1) not in ("(", "."):
                j = i + 1
                while j < len(self.tokens) and self.tokens[j].kind != "string" and self.at(j) != ";":
                    j += 1
                if j < len(self.tokens) and self.tokens[j].kind == "string":
                    source = self.tokens[j].text[1:-1]
                    k = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) not in (",", "from"))
                    if self.is_name(k) and self.at(k) != "from" or self.at(k) == "from" and self.at(k + 1) == "from":
                        self.add("import", self.at(k), "DEFAULT", i, j, text=source)
                        k += 1
                    if self.at(k) == ",":
                        k += 1
                    if self.at(k) == "*":
                        self.add("import", self.at(k + 2), "NAMESPACE", i, j, text=source)
                    elif self.at(k) == "{":
                        n, stop = k + 1, self.close(k)
                        while n < stop:
                            n += self.at(n) == "type" and self.is_name(n + 1) and self.at(n + 1) != "as"
                            if self.is_name(n):
                                self.add("import", self.at(n), "NAMED", i, j, text=source)
                            while n < stop and self.at(n) != ",":
                                n += 1
                            n += 1
                i = j
            i += 1

    def es_code(self, i: int, end: int, owner: str | None) -> None:
        while i < end:
            t, first = self.at(i), i
            while self.at(first - 1) in ("export", "default", "async", "abstract", "declare") and first > 0:
                first -= 1
            exported = "default" if self.at(first) == "export" and self.at(first + 1) == "default" else None
            if self.at(i - 1) in (".", "?."):
                i += 1
            elif t == "class" and (self.is_name(i + 1) or self.at(i + 1) == "{"):
                i = self.es_class(first, i, end, owner, exported)
            elif t == "function":
                i = self.es_function(first, i, end, owner, exported)
            elif t == "interface" and self.is_name(i + 1) and self.at(i + 2) in ("{", "<", "extends"):
                j = self.skip_angles(i + 2) if self.at(i + 2) == "<" else i + 2
                head = j
                while j < end and self.at(j) != "{":
                    j += 1
                if self.at(head) == "extends":
                    for target in self.type_names(head + 1, j):
                        self.add("heritage", target, "EXTENDS", i, i, self.at(i + 1), extra="INTERFACE")
                self.add("symbol", self.at(i + 1), "INTERFACE", first, self.close(j), owner, self.signature(first, j), exported)
                i = self.close(j) + 1
            elif t == "enum" and self.is_name(i + 1) and self.at(i + 2) == "{":
                self.add("symbol", self.at(i + 1), "ENUM", first, self.close(i + 2), owner, self.signature(first, i + 2), exported)
                i = self.close(i + 2) + 1
            elif t in ("const", "let", "var") and self.at(i + 1) != "enum":
                i = self.es_declarators(first, i, end, owner)
            else:
                i += 1

    def es_function(self, first: int, i: int, end: int, owner: str | None, exported: str | None) -> int:
        j = i + 1 + (self.at(i + 1) == "*")
        name = self.at(j) if self.is_name(j) else None
        if name:
            self.declared.add(j)
            j += 1
        if self.at(j) == "<":
            j = self.skip_angles(j)
        body = self.function_body(self.close(j) + 1, end) if self.at(j) == "(" else j
        last = self.close(body) if self.at(body) == "{" else body
        if name:
            self.add("symbol", name, "FUNCTION", first, min(last, end), owner, self.signature(first, body), exported)
        if self.at(body) == "{":
            self.es_code(body + 1, last, owner)
        return max(last, i) + 1

    def function_body(self, i: int, end: int) -> int:
        """The '{' of a body after the parameters, past a return type; the ';' of a bare signature."""
        if self.at(i) == ":":
            i += 1
            if self.at(i) == "{":
                i = self.close(i) + 1
            while i < end and self.at(i) not in ("{", ";", "=>"):
                i = self.close(i) + 1 if self.at(i) in ("(", "[") else i + 1
        return i

    def es_class(self, first: int, i: int, end: int, owner: str | None, exported: str | None) -> int:
        name = self.at(i + 1) if self.is_name(i + 1) and self.at(i + 1) not in ("extends", "implements") else None
        j = i + 1 + bool(name)
        if self.at(j) == "<":
            j = self.skip_angles(j)
        head = j
        while j < end and self.at(j) != "{":
            j = self.close(j) + 1 if self.at(j) in ("(", "[") else j + 1
        marks = [k for k in range(head, j) if self.at(k) in ("extends", "implements")] + [j]
        for k, stop in zip(marks, marks[1:]):
            for target in self.type_names(k + 1, stop):
                if name:
                    self.add("heritage", target, "EXTENDS" if self.at(k) == "extends" else "IMPLEMENTS", i, i, name, extra="CLASS")
        last = self.close(j)
        if name:
            self.add("symbol", name, "CLASS", first, last, owner, self.signature(first, j), exported)
        k = j + 1
        inside = name or owner
        while k < last:
            start = k
            while self.at(k) == "@":
                k += 2
                while self.at(k) == ".":
                    k += 2
                if self.at(k) == "(":
                    k = self.close(k) + 1
            while (self.at(k) in _ES_MODIFIERS or self.at(k) == "*") and self.at(k + 1) not in ("(", "=", ";", ":", "?", "!"):
                if self.at(k) == "static" and self.at(k + 1) == "{":
                    break
                k += 1
            if self.at(k) == "static" and self.at(k + 1) == "{":
                self.es_code(k + 2, self.close(k + 1), inside)
                k = self.close(k + 1) + 1
                continue
            if self.at(k) == "#":
                k += 1
            if self.at(k) in (";", "}"):
                k += 1
                continue
            member = k
            label = self.at(k) if self.is_name(k) or self.tokens[k].kind in ("string", "number") else None
            k = self.close(k) + 1 if self.at(k) == "[" else k + 1
            if self.at(k) in ("?", "!"):
                k += 1
            if self.at(k) == "<":
                k = self.skip_angles(k)
            if self.at(k) == "(":
                body = self.function_body(self.close(k) + 1, last)
                stop = self.close(body) if self.at(body) == "{" else min(body, last)
                self.declared.add(member)
                if label:
                    kind = "CONSTRUCTOR" if label == "constructor" else "METHOD"
                    self.add("symbol", label.strip("'\""), kind, start, stop, inside, self.signature(start, body))
                if self.at(body) == "{":
                    self.es_code(body + 1, stop, inside)
                k = stop + 1
                continue
            stop = k
            while stop < last and self.at(stop) != ";":
                if self.at(stop) in ("(", "[", "{"):
                    stop = self.close(stop)
                elif stop > k and self.tokens[stop].line > self.tokens[stop - 1].line and self.at(stop - 1) not in ("=", "=>", ",", "+", "?", ":", ".", "|", "&"):
                    break
                stop += 1
            if label:
                self.add("symbol", label.strip("'\""), "FIELD", start, max(start, stop - 1), inside, self.signature(start, stop))
            self.es_code(k, stop, inside)
            k = stop + (self.at(stop) == ";")
            k = max(k, member + 1)
        return last + 1

    def es_declarators(self, first: int, i: int, end: int, owner: str | None) -> int:
        j = i + 1
        while j < end:
            start = j
            if self.at(j) in ("{", "["):
                name = self.signature(j, self.close(j) + 1)
                j = self.close(j) + 1
            elif self.is_name(j):
                name = self.at(j)
                j += 1
            else:
                return j
            while j < end and self.at(j) not in ("=", ",", ";", "of", "in", ")"):
                if self.tokens[j].line > self.tokens[j - 1].line and self.at(j - 1) not in (":", "|", "&"):
                    break
                j = self.close(j) + 1 if self.at(j) in ("(", "[", "{") else self.skip_angles(j) if self.at(j) == "<" else j + 1
            value = j + 1
            callable_ = False
            stop = j
            if self.at(j) == "=":
                k = value + (self.at(value) == "async")
                if self.at(k) == "function":
                    callable_ = True
                elif self.is_name(k) and self.at(k + 1) == "=>":
                    callable_ = True
                else:
                    n = self.skip_angles(k) if self.at(k) == "<" else k
                    if self.at(n) == "(":
                        after = self.close(n) + 1
                        if self.at(after) == ":":
                            after = self.function_body(after, end)
                        callable_ = self.at(after) == "=>"
                stop = value
                while stop < end and self.at(stop) not in (",", ";", ")", "}"):
                    if self.at(stop) in ("(", "[", "{"):
                        stop = self.close(stop)
                    elif stop > value and self.tokens[stop].line > self.last_line(stop - 1) and self.at(stop - 1) not in (
                            "=", "=>", "+", "-", "*", "?", ":", ".", "|", "&", "<", ">") and self.at(stop) not in (".", "?", ":", "+", "-", "*", "|", "&", "/", "="):
                        break
                    stop += 1
            begin = first if start == i + 1 else start
            self.add("symbol", name[:255], "FUNCTION" if callable_ else "VARIABLE", begin, max(start, stop - 1), owner,
                     self.signature(begin, min(stop, start + 40)) if not callable_ else self.signature(begin, j))
            if callable_:
                self.es_code(value, stop, owner)
            j = stop
            if self.at(j) != ",":
                return j + (self.at(j) == ";")
            j += 1
        return j


MAX_CHUNK_LINES = 180
BLANK_WINDOW = 25


def split_large(lines: list[str], first: int) -> list[tuple[int, int]]:
    """Line ranges of at most 180 lines, cut after the last blank line among the final 25 of each window."""
    out, at = [], 0
    while len(lines) - at > MAX_CHUNK_LINES:
        stop = at + MAX_CHUNK_LINES
        for k in range(stop - 1, stop - BLANK_WINDOW - 1, -1):
            if not lines[k].strip():
                stop = k + 1
                break
        out.append((first + at, first + stop - 1))
        at = stop
    out.append((first + at, first + len(lines) - 1))
    return out


def build_chunks(text: str, facts: list[Fact]) -> list[Fact]:
    """Chunks of a text: whole callables, fields and variables, heads of types with members, and code outside of all symbols."""
    lines = text.split("\n")
    symbols = [f for f in facts if f.tag == "symbol"]
    chunks: list[Fact] = []

    def cut(a: int, b: int, name: str, kind: str) -> None:
        for x, y in split_large(lines[a - 1:b], a):
            content = "\n".join(lines[x - 1:y])
            if content.strip():
                chunks.append(Fact("chunk", name, kind, x, y, text=content))

    for s in symbols:
        nested = [t for t in symbols if t is not s and s.start_line <= t.start_line and t.end_line <= s.end_line and t.parent == s.name]
        if s.kind in ("CLASS", "INTERFACE", "ENUM") and nested:
            stop = min((t.start_line for t in nested if t.start_line > s.start_line), default=s.start_line + 1) - 1
            if s.kind != "ENUM":
                head = s.start_line
                while head < stop and "{" not in lines[head - 1]:
                    head += 1
                stop = head
            cut(s.start_line, max(s.start_line, stop), s.name, s.kind)
        else:
            cut(s.start_line, s.end_line, s.name, s.kind)
    covered = set()
    for s in symbols:
        covered.update(range(s.start_line, s.end_line + 1))
    start = None
    inside_comment = False
    for n, line in enumerate([*lines, ""], 1):
        t = line.strip()
        comment = inside_comment or t.startswith(("//", "/*", "*"))
        inside_comment = (inside_comment or t.startswith("/*")) and "*/" not in t
        loose = n <= len(lines) and n not in covered and t and not comment and not re.match(r"(?:import|package)\b|[\])}]+;?$", t)
        if loose and start is None:
            start = n
        elif not loose and start is not None:
            cut(start, n - 1, "", "FILE")
            start = None
    seen, out = set(), []
    for c in chunks:
        key = (c.start_line, c.end_line, c.text)
        if key not in seen:
            seen.add(key)
            out.append(c)
    return out


def extract(path: str | None, text: str | None) -> list[Fact]:
    """All facts of a text by its path's extension; none for other files, null or empty texts."""
    ext = "." + (path or "").rsplit(".", 1)[-1].lower()
    if not text or ext not in (".java", ".js", ".jsx", ".ts", ".tsx"):
        return []
    text = text.replace("\r\n", "\n").lstrip("﻿")
    scanner = _Scanner(text)
    if scanner.tokens:
        scanner.java() if ext == ".java" else scanner.ecmascript()
    return [*scanner.facts, *build_chunks(text, scanner.facts)]


_SCHEMA = ("repository_id string, file_id string, path string, tag string, no int, name string, kind string, start_line int, end_line int, "
           "parent string, text string, extra string")


def parse_files(contents: DataFrame) -> DataFrame:
    """One row per fact of every file. contents: file_id, repository_id, path, content; texts of any length are read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, r, p, c in zip(batch["file_id"], batch["repository_id"], batch["path"], batch["content"]):
                rows += [(r, f, p, x.tag, n, x.name, x.kind, x.start_line, x.end_line, x.parent, x.text, x.extra)
                         for n, x in enumerate(extract(p, c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return contents.select("file_id", "repository_id", "path", "content").mapInPandas(run, _SCHEMA)


def parsed_symbols(facts: DataFrame) -> DataFrame:
    """Symbols with an id made of repository, file, place and name."""
    key = F.concat_ws("\0", "repository_id", "file_id", "name", "kind", F.col("start_line").cast("string"), F.col("no").cast("string"))
    return facts.filter("tag = 'symbol'").select(
        F.sha2(key, 256).alias("id"), "repository_id", "file_id", "path", "name", F.col("kind").alias("type"), "start_line", "end_line", "parent",
        F.col("text").alias("signature"), (F.col("extra") == "default").alias("is_default"))
