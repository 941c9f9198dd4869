"""Lexers for Java and for JavaScript / TypeScript with templates and JSX.

A lexer gives (kinds, after_line_end) of all tokens, EOF last, or None where the
characters themselves are already invalid (an open string, a wrong escape, tags
that do not match).
"""

from __future__ import annotations

import re

from quarrylens.llm.syntax.grammars import ES_CONTEXTUAL, ES_RESERVED, JAVA_CONTEXTUAL, JAVA_RESERVED

Tokens = tuple[list[str], list[bool]]

_JAVA_TOKEN = re.compile(
    r'''(?P<space>[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*(?s:.*?)\*/)
    |(?P<word>(?:[^\W\d]|\$)(?:\w|\$)*)
    |(?P<NUM>0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*\.?(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?|\.[0-9a-fA-F]+)(?:[pP][+-]?\d+[fFdD]?|[lL])?
        |0[bB][01](?:_*[01])*[lL]?
        |(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[fFdDlL]?)
    |(?P<BLOCKSTR>"""[ \t\f]*\r?\n(?s:(?:\\.|[^\\])*?)""")
    |(?P<STRING>"(?:\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^"\\\r\n])*")
    |(?P<CHAR>'(?:\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^'\\\r\n])')
    |(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||[=!<]=|<<=?|[-+*/%&|^]=|[-+*/%&|^=<>!~?:;,.(){}\[\]@])''',
    re.X,
)
_NON_SEALED = re.compile(r"-sealed\b")
_BAD_OCTAL = re.compile(r"0[\d_]*[89][\d_]*[lL]?$")
_JAVA_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp".split())
_JAVA_WORDS = frozenset(JAVA_RESERVED) | frozenset(JAVA_CONTEXTUAL)


def lex_java(text: str) -> Tokens | None:
    kinds: list[str] = []
    at, n = 0, len(text)
    match = _JAVA_TOKEN.match
    while at < n:
        m = match(text, at)
        if not m:
            return None
        group = m.lastgroup
        at = m.end()
        if group == "space":
            continue
        if group == "word":
            word = m.group()
            if word == "non" and _NON_SEALED.match(text, at):
                at += 7
                kinds.append("non-sealed")
            else:
                if word in _JAVA_MODIFIERS and kinds and kinds[-1] == word:
                    return None
                kinds.append(word if word in _JAVA_WORDS else "ID")
        elif group == "op":
            kinds.append(m.group())
        else:
            if group == "NUM" and (at < n and (text[at].isalnum() or text[at] in "_$") or _BAD_OCTAL.match(m.group())):
                return None
            kinds.append(group)
    kinds.append("EOF")
    return kinds, [False] * len(kinds)


_ES_SPACE = re.compile(r"(?:[ \t\v\f ﻿  \r\n]+|//[^\r\n  ]*|/\*(?s:.*?)\*/)+")
_LINE_END = re.compile(r"[\r\n  ]")
_ES_TOKEN = re.compile(
    r"""(?P<word>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|‌|‍|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<PRIVATE>\#(?:[^\W\d]|\$)(?:\w|\$)*)
    |(?P<NUM>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?
        |(?:0|[1-9](?:_?\d)*)n
        |(?:(?:0|[1-9](?:_?\d)*)\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)
    |(?P<STRING>"(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu1-9])|[^"\\\r\n])*"
        |'(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu1-9])|[^'\\\r\n])*')
    |(?P<op>\.\.\.|=>|\?\?=|\?\?|\?\.(?!\d)|===|!==|\*\*=|\*\*|\+\+|--|&&=|\|\|=|&&|\|\||<<=|<<|<=|==|!=|[-+*/%&|^]=|[-+*/%&|^=<>!~?:;,.()\[\]@])""",
    re.X,
)
_TPL = re.compile(r"(?:\\(?s:.)|\$(?!\{)|[^`\\$])*")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/(?P<flags>\w*)")
_ES_WORDS = frozenset(ES_RESERVED) | frozenset(ES_CONTEXTUAL)
_VALUE_ENDS = frozenset(["ID", "NUM", "STRING", "REGEX", "TPL", "TTAIL", ")", "]", "}", "this", "super", "null", "true", "false", "PRIVATE",
                         "++", "--", "J/>", "JEND", *ES_CONTEXTUAL])
_CONDITIONS = frozenset(["if", "while", "for", "with"])
_ANGLES = {"<": 1, "<<": 2, ">": -1}
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*(?:\s*[.:]\s*[^\W\d][\w$-]*)*")
_JSX_SPACE = re.compile(r"(?:\s+|//[^\r\n]*|/\*(?s:.*?)\*/)+")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^{}<>]+")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")


def lex_ecmascript(text: str, typescript: bool, jsx: bool) -> Tokens | None:
    kinds: list[str] = []
    ends: list[bool] = []
    modes: list[str] = []  # what a '}' or the end of a tag returns to
    parens: list[bool] = []  # does the parenthesis belong to a condition?
    angles: list[int] = []  # open '<' of the type arguments of each tag
    tags: list[str] = []
    at, n = (1 if text.startswith("﻿") else 0), len(text)
    if text.startswith("#!", at):
        m = _LINE_END.search(text, at)
        at = m.start() if m else n
    newline = False
    space, token = _ES_SPACE.match, _ES_TOKEN.match
    prev = ""

    def put(kind: str) -> None:
        nonlocal prev, newline
        kinds.append(kind)
        ends.append(newline)
        newline = False
        prev = kind

    def template(head: str, tail: str) -> bool:
        nonlocal at
        at = _TPL.match(text, at).end()
        if text.startswith("`", at):
            at += 1
            put(tail)
            return True
        if text.startswith("${", at):
            at += 2
            put(head)
            modes.append("tpl")
            return True
        return False

    while True:
        mode = modes[-1] if modes else ""
        if mode == "tag":
            m = _JSX_SPACE.match(text, at)
            if m:
                at = m.end()
            if at >= n:
                return None
            if text.startswith("/>", at):
                at += 2
                modes.pop()
                tags.pop()
                put("J/>")
                newline = False
                continue
            c = text[at]
            if c == ">":
                at += 1
                put("J>")
                modes[-1] = "children"
                continue
            if c == "{":
                at += 1
                put("{")
                modes.append("brace")
                continue
            if c == "=":
                at += 1
                put("J=")
                continue
            if c in "\"'":
                m = _JSX_STRING.match(text, at)
                if not m:
                    return None
                at = m.end()
                put("STRING")
                continue
            if c == "<" and prev == "J=":
                at += 1
            elif c == "<" and typescript and prev == "JNAME" and kinds[-2] == "J<":
                modes.append("types")
                angles.append(0)
                continue
            else:
                m = _JSX_NAME.match(text, at)
                if not m:
                    return None
                at = m.end()
                put("JNAME")
                continue
            opening = True
        elif mode == "children":
            if at >= n:
                return None
            c = text[at]
            if c == "{":
                at += 1
                put("{")
                modes.append("brace")
                continue
            if c in "}>":
                return None
            if c != "<":
                at = _JSX_TEXT.match(text, at).end()
                put("JTEXT")
                continue
            m = re.compile(r"<\s*/\s*").match(text, at)
            if m:
                at = m.end()
                put("J</")
                m = _JSX_NAME.match(text, at)
                name = re.sub(r"\s", "", m.group()) if m else ""
                if m:
                    at = m.end()
                    put("JNAME")
                m = _JSX_SPACE.match(text, at)
                if m:
                    at = m.end()
                if not text.startswith(">", at) or not tags or tags.pop() != name:
                    return None
                at += 1
                put("J>")
                prev = "JEND"
                modes.pop()
                continue
            at += 1
            opening = True
        else:
            opening = False
            m = space(text, at)
            if m:
                if _LINE_END.search(text, at, m.end()):
                    newline = True
                at = m.end()
            if at >= n:
                break
            c = text[at]
            if c == "`":
                at += 1
                if not template("THEAD", "TPL"):
                    return None
                continue
            if c == "{":
                at += 1
                put("{")
                modes.append("brace")
                continue
            if c == "}":
                at += 1
                if mode == "tpl":
                    modes.pop()
                    if not template("TMID", "TTAIL"):
                        return None
                    continue
                if mode == "brace":
                    modes.pop()
                else:
                    return None
                put("}")
                continue
            if c == "/" and prev not in _VALUE_ENDS or c == "/" and prev == "}" and newline:
                m = _REGEX.match(text, at)
                if m:
                    flags = m.group("flags")
                    if set(flags) - set("dgimsuvy") or len(set(flags)) != len(flags):
                        return None
                    at = m.end()
                    put("REGEX")
                    continue
            if c == "<" and jsx and mode != "types" and (prev not in _VALUE_ENDS or prev == "}" and newline):
                if not (typescript and _GENERIC_ARROW.match(text, at)):
                    at += 1
                    opening = True
        if opening:
            put("J<")
            m = _JSX_SPACE.match(text, at)
            if m:
                at = m.end()
            m = _JSX_NAME.match(text, at)
            if m:
                at = m.end()
                put("JNAME")
                tags.append(re.sub(r"\s", "", m.group()))
            else:
                tags.append("")
            modes.append("tag")
            continue
        m = token(text, at)
        if not m:
            return None
        group = m.lastgroup
        at = m.end()
        if group == "word":
            word = m.group()
            after_dot = prev in (".", "?.")
            put(word if word in _ES_WORDS else "ID")
            if after_dot and word in _ES_WORDS and word in ES_RESERVED:
                prev = "ID"
        elif group == "op":
            word = m.group()
            if word == "(":
                parens.append(prev in _CONDITIONS)
            put(word)
            if word == ")" and parens and parens.pop():
                prev = "condition"
            elif mode == "types" and word in _ANGLES:
                angles[-1] += _ANGLES[word]
                if angles[-1] <= 0:
                    angles.pop()
                    modes.pop()
        else:
            if group == "NUM" and at < n and (text[at].isalnum() or text[at] in "_$"):
                return None
            put(group)
    if modes or tags:
        return None
    kinds.append("EOF")
    ends.append(newline)
    return kinds, ends
