"""Credentials embedded in source code: find them and hide them.

The text is cut into lexical tokens (comments, text blocks, strings, templates,
names, operators). A literal is a finding if it has the shape of a known access
token, or if it is not a placeholder and is assigned, defaulted, compared or
passed to something with a credential's name. Comments and embedded text (YAML,
properties, URLs, headers, command lines) are searched for the same pairs.
Hiding overwrites only the value's characters, so that delimiters, escapes, line
ends and all code around it stay as they are.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Finding(NamedTuple):
    line_no: int
    kind: str
    name: str
    spans: tuple[tuple[int, int], ...]


_KEY_RUN = re.compile(r"(?:[A-Za-z0-9+/=]{16,}|\\[nr]|[\s\"'`+,])*+[A-Za-z0-9+/=]*")
_KEY_LINE = re.compile(r"(?<![\\A-Za-z0-9+/=])[A-Za-z0-9+/]+={0,2}(?=\\[nr]|[\s\"'`]|$)|(?<=\\[nr])[A-Za-z0-9+/]+={0,2}")
#: Letters without which no pair in a comment or embedded text names a credential.
_HINT = re.compile(r"(?i)pass|pwd|pw|secret|token|cred|auth|key|phrase|kennwort|contras|senha|motdepasse|bearer|basic|jwt|pat\b")

# Words that name a credential, and words that make a name something else.
_SECRET_WORDS = frozenset(
    "password passwd passwort passphrase phrase pwd pw pass passcode kennwort contrasena contrasenha senha motdepasse "
    "secret token credential credentials cred creds apikey authorization auth bearer jwt pat".split()
)
_PASSWORD_WORDS = frozenset(
    "password passwd passwort passphrase phrase pwd pw pass passcode kennwort contrasena contrasenha senha motdepasse".split()
)
_GRANT_WORDS = frozenset("granted grant authenticated authorized authorised allowed permitted unlocked loggedin isadmin signedin admitted".split())
_KEY_QUALIFIERS = frozenset(
    "api secret private access signing sign encryption auth service client account master admin app aes hmac rsa ssh "
    "deploy license stripe webhook shared".split()
)
_PREFIX_VERBS = frozenset("set with add use put assign apply configure get fetch read load".split())
_DECODERS = re.compile(r"(?i)(decode|atob|unhex|from_?(base64|hex)|b64|base64|^from$|fromcharcode|^string$|^valueof$|tochararray|getbytes|^of$|^concat$|^join$|reverse)")
_DEFAULTING = re.compile(r"(?i)(ordefault|orelse|getproperty|defaultto|^get$|^env$|^getenv$|^optional$|^option$)")
_LOGIN = re.compile(r"(?i)^(set_?credentials|log_?in|sign_?in|authenticate|auth|connect|get_?connection|credentials|basic_?auth|set_?basic_?auth|with_?credentials|create_?connection|password_?authentication)$")
_PAIR_SETTERS = re.compile(r"(?i)(header|^set$|^put$|^add$|^append$|property|^entry$|^param|^with$|attribute|^option$|^field$|^of$)")

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_PREFIXED = re.compile(
    r"""(?<![A-Za-z0-9])(?:
      (?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])
     |gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}
     |xox[abeprs]-[A-Za-z0-9-]{12,}
     |[sr]k_(?:live|test)_[A-Za-z0-9]{10,}
     |AIza[\w-]{30,}
     |glpat-[\w-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}
     |SG\.[\w-]{16,}\.[\w-]{16,}
     |[a-z]{2,}[-_](?:pat|key|tok|token|secret)[-_][A-Za-z0-9]{20,}
     |eyJ[\w-]{8,}\.eyJ[\w-]{6,}\.[\w-]{10,}
    )""",
    re.X,
)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_URL_USER = re.compile(r"[A-Za-z][\w+.-]*://([^\s/:@\"'`<>]*):([^\s@\"'`<>]+?)@(?=[\w\[$<{%])")
_URL_PARAM = re.compile(r"[?&;]([A-Za-z_][\w.-]*)=([^\s&;#\"'`<>]+)")
_URL = re.compile(r"://[^\s\"'`<>]+")
_MARKUP = re.compile(r"<[\w.:-]+\s[^<>]*?\b(?:name|key|id)\s*=\s*[\"']([\w.-]+)[\"'][^<>]*?\bvalue\s*=\s*[\"']([^\"'<>]+)[\"']|<([\w.-]+)>([^<>\s]+)</\3>")
_SCHEME = re.compile(r"(?i)^\s*(basic|bearer|token|digest|apikey)\s+(\S+)\s*$")
_SCHEME_IN_TEXT = re.compile(r"(?i)\b(basic|bearer)\s+([A-Za-z0-9+/=_.~-]{8,})")
_TEXT_PAIR = re.compile(
    r"""(?:(?<=[\s,;{("'<|*#-])|^)["']?([A-Za-z_][\w.\-]*)["']?[ \t]*(?::=|=>|[:=])[ \t]*(?:(bearer|token|basic)[ \t]+)?
        (?:"((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'|([^\s"'`,;<>\\]+))""",
    re.X | re.I | re.M,
)
_ACCOUNT_PAIR = re.compile(r"(?m)[:=]\s*([A-Za-z][\w.@-]*)\s+(?:/|\|)\s+(\S+)[ \t]*\r?$|[:=]\s*([A-Za-z][\w.@-]*)\s*(?:/|:)\s*(\S+)[ \t]*\r?$")
_SPOKEN = re.compile(r"(?i)\b(?:password|passwort|passphrase|secret|token|pwd|kennwort|api[ -]?key)\b(?:\s+(?:is|ist|was|war|lautet|=))\s+[\"'`]?([^\s\"'`]+)")

_PLACEHOLDER = re.compile(
    r"""(?ix)
    ^[\W_]*$ | ^(?:x|\*|\.|-|_|\#|0|•)+$ | ^(.)\1{3,}$ | x{4,} | \*{4,} | \.{3}
    | your[-_ ]? | change[-_ ]?(?:me|it|this) | replace | todo | fixme | placeholder | example | dummy | redacted
    | insert[-_ ] | [-_ ]here$ | ^(?:null|none|nil|undefined|true|false|yes|no|n/?a|tbd|empty|secret|password|token|test|changeit)$
    | ^<.*>$ | ^\{\{.*\}\}$ | ^%[\w.]*%?$ | ^\$\w | \$\{ | ^\#\{ | \{\{ | ^@\w+@$ | ^%[sd]$
    | ^(?:env|vault|secret|ssm|arn|file|classpath|config|ref|kms|aws|gcp|op):
    """,
)
_REGEX_LIKE = re.compile(r"^\^|\[[a-zA-Z0-9]-[a-zA-Z0-9]|\{\d+,?\d*\}|\\[dws]|\(\?")
_PATH_LIKE = re.compile(r"^[\w.-]*(?:/[\w.-]+)+/?$")
_WORDY = re.compile(r"^[A-Za-z]+(?:[-_. :/][A-Za-z]+)*[-_. :/]?$")
_DOTTED = re.compile(r"^[a-z][\w-]*(?:\.[a-z][\w-]*)+$")
_ENV_NAME = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|crc\d*)[-:]|:sha\d+:|^\$2[aby]?\$|^\$argon")


def name_words(name: str) -> list[str]:
    """Lower-case words of an identifier, its trailing numbers dropped."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    return words


@lru_cache(65536)
def is_credential_name(name: str) -> bool:
    """Does a thing with this name hold a credential? Its last word decides."""
    words = name_words(name.rsplit(".", 1)[-1])
    if words and words[0] in _PREFIX_VERBS and len(words) > 1:
        words = words[1:]
    if not words:
        return False
    last, joined = words[-1], "".join(words)
    if last in _SECRET_WORDS or joined in _SECRET_WORDS:
        return True
    if len(words) > 1 and "".join(words[-2:]) in _SECRET_WORDS:
        return True
    if len(words) > 2 and "".join(words[-3:]) in _SECRET_WORDS:
        return True
    return last == "key" and len(words) > 1 and words[-2] in _KEY_QUALIFIERS


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def looks_random(text: str) -> bool:
    """Letters and digits as no person writes them."""
    if _UUID.match(text):
        return True
    core = re.sub(r"[^A-Za-z0-9]", "", text)
    if len(core) < 16 or " " in text:
        return False
    classes = sum(bool(re.search(c, core)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return classes >= 2 and entropy(core) > (3.0 if re.fullmatch("[0-9a-fA-F]+", core) else 3.4)


_ODD_PIECE = re.compile(r"^.{1,2}$|^[^aeiouy]+$|[bcdfghjklmnpqrstvwxz]*[jkqvxz][bcdfghjklmnpqrstvwxz]{2}|[bcdfghjklmnpqrstvwxz]{2}[jqvxz]|([hijkquvwxy])\1")
_SHORT_WORDS = frozenset("pw pwd api key id db url ssh jwt tls ssl http https my is no of to in on by aws gcp smtp".split())


def looks_scrambled(text: str) -> bool:
    """Letters only, but not as words are spelt or joined."""
    if len(text) < 8 or not text.isalpha():
        return False
    pieces = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", text)]
    odd = sum(p not in _SHORT_WORDS and _ODD_PIECE.search(p) is not None for p in pieces)
    return odd >= 2 or odd == 1 and len(pieces) <= 2


def is_secret_value(value: str, name: str = "", how: str = "") -> bool:
    """Could this be a real credential, given that its place is one for credentials?

    With the name it goes to and the way it goes there, words and sentences count as
    passwords and passphrases where nothing but the value itself can be meant.
    """
    v = value.strip()
    if len(v) < 5:
        return False
    spoken = how in ("=", "call", "default", "pair", "==") and _password_name(name)
    if re.search(r"\s", v):
        return spoken and v == value and _PLACEHOLDER.search(v) is None and _spaced_secret(v, name)
    if _PLACEHOLDER.search(v) or _REGEX_LIKE.search(v) or _ENV_NAME.match(v) or _DIGEST.search(v):
        return False
    if _WORDY.match(v):
        return (looks_scrambled(v) or looks_random(v) and bool(re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v)) and len(v) >= 20
                or spoken and re.fullmatch("[a-z]{8,}", v) is not None and not any(w in v for w in _SECRET_WORDS if len(w) > 3))
    if v.isdigit() and len(v) < 8:
        return False
    if "://" in v:
        return False
    if _PATH_LIKE.match(v) and not re.search(r"\d", v):
        return False
    if _DOTTED.match(v) and not looks_random(v) and not (spoken and re.search(r"\d", v)):
        return False
    if re.match(r"^[\w.]*\(.*\)", v) or v.startswith(("process.env", "System.")):
        return False
    return True


def _password_name(name: str) -> bool:
    words = name_words(name.rsplit(".", 1)[-1])
    return bool(words) and (words[-1] in _PASSWORD_WORDS or "".join(words[-2:]) in _PASSWORD_WORDS)


def _spaced_secret(value: str, name: str) -> bool:
    """A password with blanks: digits among its words, or the bare words of a passphrase."""
    words = value.split(" ")
    if re.search(r"[.:?!]$|[<>{}()]|://", value) or any(not w for w in words):
        return False
    if re.search(r"\d", value) and len(value) >= 8:
        return not re.search(r"(?i)\b(must|enter|please|should|least|characters?|is|of|the|for|your)\b", value)
    return name_words(name)[-1].endswith("phrase") and len(words) >= 4 and all(re.fullmatch("[a-z]{2,}", w) for w in words)


def _strong(value: str) -> bool:
    """Letters, digits or signs enough for a secret even where other parts of it are unknown."""
    return "://" not in value and (looks_random(value) or len(value) >= 8 and len(re.findall(r"[A-Z0-9!#$%&*+=^~]", value)) >= 4)


@lru_cache(65536)
def _grants(name: str) -> bool:
    return not _GRANT_WORDS.isdisjoint(name_words(name)) or "".join(name_words(name)[:2]) in _GRANT_WORDS


def _basic_password(encoded: str) -> bool:
    try:
        plain = base64.b64decode(encoded + "=" * (-len(encoded) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = plain.partition(":")
    return bool(colon) and len(password) >= 4 and not _PLACEHOLDER.search(password)


def _header_secret(value: str, name: str = "", how: str = "") -> tuple[int, int] | None:
    """Span of the secret inside a header value, with or without a scheme before it."""
    scheme = _SCHEME.match(value)
    if scheme:
        word, rest = scheme.group(1).lower(), scheme.group(2)
        ok = _basic_password(rest) if word == "basic" else is_secret_value(rest)
        return scheme.span(2) if ok else None
    if is_secret_value(value, name, how):
        at = value.find(value.strip())
        return at, at + len(value.strip())
    return None


_BASE64ISH = re.compile(r"^[A-Za-z0-9+/_-]{6,}={0,2}$")


_REGEX_PART = r"""|(?P<regex>/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)"""
_LEX_PARTS = r"""\s*(?:(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))%s
    |(?P<block>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<tick>`)
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<op>\?\?=?|\|\|=?|&&=?|\?\.|=>|[=!]==?|[-+]=|\+\+|--|<=|>=|\S)
    |(?P<end>\Z))"""
#: Lexers for the places where a '/' divides and where it opens a regular expression.
_LEX_DIVIDE = re.compile(_LEX_PARTS % "", re.S | re.X)
_LEX_REGEX = re.compile(_LEX_PARTS % _REGEX_PART, re.S | re.X)
_TEMPLATE_TEXT = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_BEFORE_REGEX = frozenset("return case typeof in of throw delete void do else".split())
_LITERALS = frozenset(["string", "template", "block"])
_ASSIGNS = frozenset(["=", "+=", "??=", "||=", "&&="])
_COMPARES = frozenset(["==", "===", "!=", "!=="])
_OPENS = {"(": ")", "[": "]", "{": "}"}
_CLOSES = frozenset(")]}")
_CONTROL = frozenset("if for while switch catch with synchronized".split())


class _Scan:
    """One text: its tokens, the structure of their brackets, and the findings.

    A token is (kind, start, end, word); word is the text of names, numbers and
    operators and '' for literals, so that no literal is taken for code. A template
    with substitutions is a chain of template pieces and expressions joined by '+'.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: list[Finding] = []
        self.covered: list[tuple[int, int]] = []
        self.comments: list[tuple[int, int]] = []
        self.code: list[tuple[str, int, int, str]] = []
        self.lines = [m.start() for m in re.finditer("\n", text)]

    # --- tokens -----------------------------------------------------------
    def tokenize(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        code, value = self.code, False
        depth: list[int] = []  # open braces inside each substitution of a template
        close, opened = text.find("*/"), text.find("/*")
        if 0 <= close and (opened < 0 or close < opened) and "\n" in text[:close] and re.match(r"\s*\*", text):
            self.comments.append((0, close))  # the text begins inside a comment
            at = close + 2

        def template(at: int) -> int:
            end = _TEMPLATE_TEXT.match(text, at).end()
            code.append(("template", at, end, ""))
            if text.startswith("${", end):
                code.append(("op", end, end, "+"))
                depth.append(0)
                return end + 2
            return min(end + 1, n)

        while at < n:
            m = (_LEX_DIVIDE if value else _LEX_REGEX).match(text, at)
            kind = m.lastgroup
            a, at = m.start(kind), m.end()
            if kind == "op":
                word = text[a:at]
                if depth and word == "{":
                    depth[-1] += 1
                elif depth and word == "}":
                    if depth[-1] == 0:
                        depth.pop()
                        code.append(("op", a, a, "+"))
                        at = template(at)
                        value = True
                        continue
                    depth[-1] -= 1
                value = word in (")", "]", "}", "++", "--")
                code.append((kind, a, at, word))
            elif kind == "name":
                word = text[a:at]
                value = word not in _BEFORE_REGEX
                code.append((kind, a, at, word))
            elif kind == "comment":
                self.comments.append((a, at))
            elif kind == "string":
                code.append((kind, a + 1, at - 1, ""))
                value = True
            elif kind == "tick":
                at = template(at)
                value = not depth or code[-1][0] != "op"
            elif kind == "block":
                code.append((kind, a + 3, at - 3 if text.endswith('"""', a + 3, at) else at, ""))
                value = True
            elif kind != "end":
                code.append((kind, a, at, text[a:at] if kind == "number" else ""))
                value = True

    def structure(self) -> None:
        """Per token: the bracket around it, its argument number there, and the token that says where its value goes."""
        n = len(self.code)
        self.opener, self.arg, self.lead = [-1] * n, [0] * n, [-1] * n
        self.partner: dict[int, int] = {}
        self.grants: list[int] = []
        stack: list[list[int]] = [[-1, 0, -1, 0]]  # bracket, commas, lead, open conditionals
        for i, (kind, _, _, word) in enumerate(self.code):
            top = stack[-1]
            if word in _CLOSES and len(stack) > 1:
                here = stack.pop()
                self.partner[here[0]], self.partner[i] = i, here[0]
                top = stack[-1]
                if word == "}" and top[0] < 0 | (self.code[top[0]][3] == "{"):
                    self.opener[i], self.arg[i], self.lead[i] = top[:3]
                    continue
            self.opener[i], self.arg[i], self.lead[i] = top[0], top[1], top[2]
            if kind == "op":
                if word in _OPENS:
                    stack.append([i, 0, i, 0])
                elif word == ",":
                    top[1] += 1
                    top[2], top[3] = i, 0
                elif word == ";":
                    top[2], top[3] = i, 0
                elif word in _ASSIGNS or word in _COMPARES or word == "=>":
                    top[2] = i
                elif word in ("&&", "<", ">", "<=", ">="):
                    top[2] = i
                elif word == "?" and self.word(i + 1) not in (":", ",", ")"):
                    top[3] += 1
                elif word == ":":
                    if top[3]:
                        top[3] -= 1
                    else:
                        top[2] = i
            elif word in ("return", "case", "throw"):
                top[2], top[3] = i, 0
            elif kind == "name" and _grants(word):
                self.grants.append(i)

    def word(self, i: int) -> str:
        return self.code[i][3] if 0 <= i < len(self.code) else ""

    def kind(self, i: int) -> str:
        return self.code[i][0] if 0 <= i < len(self.code) else ""

    def value(self, i: int) -> str:
        _, a, b, _ = self.code[i]
        return self.text[a:b]

    def report(self, kind: str, name: str, spans: list[tuple[int, int]], at: int | None = None) -> None:
        for a, b in spans:
            k = bisect_left(self.covered, (a, -1))
            if k < len(self.covered) and self.covered[k][0] < b or k and self.covered[k - 1][1] > a:
                return
        for span in spans:
            insort(self.covered, span)
        line = bisect_left(self.lines, spans[0][0] if at is None else at) + 1
        self.found.append(Finding(line, kind, name, tuple(spans)))

    # --- where a literal goes ----------------------------------------------
    def left_name(self, i: int, which: int = 0) -> str:
        """Name left of the '=' at token i, over a type annotation; `which` picks from a pattern of names."""
        j = i - 1
        if self.word(j) == "]":
            start = self.partner.get(j, -1)
            if self.kind(j - 1) == "string" and start == j - 2:
                return self.value(j - 1)
            if start > 0 and self.kind(start - 1) == "name" and self.word(start - 1) not in ("const", "let", "var") and start + 1 == j:
                return self.word(start - 1)  # an array declared as `name[] = `
            names = [k for k in range(start + 1, j) if self.kind(k) == "name" and self.opener[k] == start and self.arg[k] == which]
            if start >= 0 and names and (self.kind(start - 1) != "name" or self.word(start - 1) in ("const", "let", "var")):
                return self.word(names[0])
        first = self.word(j) if self.kind(j) == "name" else ""
        while j >= 0:
            w = self.word(j)
            if w in ("]", "}", ")") and self.partner.get(j, -1) >= 0 and self.opener[self.partner[j]] == self.opener[i]:
                j = self.partner[j] - 1
                continue
            if w in (";", "{", "}", "(", ")", "=", "[") or w == "," and not first:
                break
            if w == ":" and self.kind(j - 1) == "name":
                return self.word(j - 1)
            if w == ":" and self.word(j - 1) == "?":
                return self.word(j - 2)
            if not first and self.kind(j) == "name" and self.word(j + 1) in ("[", "="):
                first = w
            if w == ",":
                break
            j -= 1
        return first

    def chain_start(self, i: int) -> int:
        """First token of the call chain whose last name is token i."""
        j = i
        while j > 0:
            if self.word(j - 1) == "new":
                j -= 1
            elif self.word(j - 1) in (".", "?."):
                j -= 2
                while self.word(j) in (")", "]") and self.partner.get(j, -1) > 0:
                    j = self.partner[j] - 1
            else:
                break
        return max(j, 0)

    def sibling(self, i: int, which: int) -> int:
        """First token of argument `which` of the call around token i."""
        k = self.opener[i] + 1
        while k < i and self.arg[k] != which:
            k = self.partner.get(k, k) + 1 if self.word(k) in _OPENS else k + 1
        return k

    def target(self, i: int) -> tuple[str, str]:
        """(name, how) of what receives the value at token i; '' if nothing with a name does."""
        which = 0
        while True:
            k, prev = self.lead[i], self.word(i - 1)
            if prev in ("??", "||") and self.kind(i - 2) in ("name", "string"):
                named = self.word(i - 2) or self.value(i - 2)
                if is_credential_name(named):
                    return named, "default"
            w = self.word(k)
            if k < 0:
                return "", ""
            if w in _ASSIGNS:
                return self.left_name(k, which), "="
            if w in _COMPARES:
                return (self.word(k - 1) if self.kind(k - 1) == "name" else ""), "=="
            if w == ":":
                if self.kind(k - 1) == "string":
                    return self.value(k - 1), ":"
                if self.word(k - 1) == "?":
                    return self.word(k - 2), ":"
                return (self.word(k - 1) if self.kind(k - 1) == "name" else ""), ":"
            if w == "return":
                return self.function_name(k), "return"
            if w == "=>":
                j = k - 1
                if self.word(j) == ")":
                    j = self.partner.get(j, 0)
                j -= self.word(j - 1) == "async"
                return (self.left_name(j - 1), "return") if self.word(j - 1) == "=" else ("", "")
            if w not in ("(", "[", "{", ","):
                return "", ""
            k, arg = self.opener[i], self.arg[i]
            if k < 0:
                return "", ""
            if self.word(k) in ("[", "{"):
                if self.word(k) == "{" and w != "{" and w != ",":
                    return "", ""
                before = self.word(k - 1)
                if before in _ASSIGNS or before in (":", "(", ",", "??", "||", "]", "?", "return", "[", "{"):
                    which = arg
                    if before == "]":  # new byte[] {...}
                        j = self.partner.get(k - 1, 0)
                        i = j - 2 if self.word(j - 2) == "new" else k
                    else:
                        i = k
                    continue
                return "", ""
            if self.kind(k - 1) != "name":
                if self.word(k - 1) in (")", "]", "}", ">") or arg:
                    return "", ""
                i = k  # a parenthesis
                continue
            callee = self.word(k - 1)
            first = self.sibling(i, 0)
            if _DECODERS.search(callee) and (arg == 0 or callee in ("of", "fromCharCode")):
                i = self.chain_start(k - 1)
                continue
            if _DEFAULTING.search(callee) and arg == 1:
                if self.kind(first) == "string" and is_credential_name(self.value(first)):
                    return self.value(first), "default"
                i = self.chain_start(k - 1)
                continue
            if arg == 0 and callee in ("equals", "equalsIgnoreCase", "contentEquals", "is", "eq") and self.word(k - 2) == ".":
                return self.word(k - 3), "=="
            if arg == 0 and is_credential_name(callee) and self.word(k - 2) != "new":
                return callee, "call"
            if arg >= 1 and _PAIR_SETTERS.search(callee) and self.kind(first) == "string":
                return self.value(first), "pair"
            if arg >= 1 and _LOGIN.search(callee) and self.word(i + 1) in (")", ",", "+"):
                return "password", "call"
            return "", ""

    def function_name(self, i: int) -> str:
        """Name of the function around the return at token i."""
        brace = self.opener[i]
        while brace > 0 and self.word(brace) == "{":
            j = brace - 1
            while j > 0 and self.word(j) not in (")", ";", "{", "}", "=>"):
                j -= 1
            if self.word(j) == "=>":
                k = self.partner.get(j - 1, j - 1) if self.word(j - 1) == ")" else j - 1
                k -= self.word(k - 1) == "async"
                return self.left_name(k - 1) if self.word(k - 1) == "=" else ""
            if self.word(j) != ")":
                if self.word(brace - 1) in ("else", "try", "do", "finally"):
                    brace = self.opener[brace]
                    continue
                return ""
            k = self.partner.get(j, -1)
            callee = self.word(k - 1)
            if callee not in _CONTROL:
                return callee if self.kind(k - 1) == "name" else ""
            brace = self.opener[brace]
        return ""

    def admits(self, i: int) -> bool:
        """Does the condition around token i open the way to a branch that grants access?"""
        k = self.opener[i]
        while k > 0 and self.word(k) == "(":
            if self.word(k - 1) == "if":
                start = self.partner.get(k, -1) + 1
                stop = self.partner.get(start, start + 4) if self.word(start) == "{" else start + 4
                at = bisect_left(self.grants, start)
                return 0 < start and at < len(self.grants) and self.grants[at] < stop
            k = self.opener[k]
        return False

    # --- literals -----------------------------------------------------------
    def joined(self, i: int) -> tuple[str, list[tuple[int, int]], int, bool]:
        """Value of the literal at token i with what '+' appends to it; spans; next token; are parts unknown?"""
        parts, spans, hole, j = [self.value(i)], [self.code[i][1:3]], False, i + 1
        while self.word(j) == "+":
            k = j + 1
            if self.kind(k) in _LITERALS:
                parts.append(self.value(k))
                spans.append(self.code[k][1:3])
                j = k + 1
            elif self.kind(k) == "number":
                parts.append(self.word(k))
                j = k + 1
            else:
                # an expression up to the next '+' of this level
                end = k
                while end < len(self.code) and self.opener[end] == self.opener[j] and self.word(end) not in ("+", ";", ",", ":", "?"):
                    if self.word(end) in _CLOSES and end not in self.partner:
                        break
                    end = self.partner.get(end, end) + 1 if self.word(end) in _OPENS else end + 1
                hole = True
                if self.word(end) != "+" or end <= j:
                    return "".join(parts), spans, max(k, j + 1), hole
                j = end
        return "".join(parts), [s for s in spans if s[1] > s[0]] or spans, j, hole

    def literal(self, i: int) -> int:
        value, spans, after, hole = self.joined(i)
        if len(value) < 5 or "-----BEGIN" in value:
            return after
        if len(spans) > 1 and not hole and _PREFIXED.search(value) and not _PLACEHOLDER.search(value):
            self.report("token", self.target(i)[0], spans)
            return after
        scheme = _SCHEME.match(value)
        name, how = self.target(i)
        if not name and self.word(after) == "." and self.word(after + 1) in ("equals", "equalsIgnoreCase") and self.kind(after + 3) == "name":
            name, how = self.word(after + 3), "=="
        elif self.word(after) in _COMPARES and self.kind(after + 1) == "name" and how != "==":
            name, how = self.word(after + 1), "=="
        if is_credential_name(name) or name_words(name) in (["key"], ["keys"]) and looks_random(value):
            hit = _header_secret(value, name, how)
            if hit and (not hole or _strong(value)) and not self._looked_up(name, value):
                a, b = spans[0]
                self.report("assigned", name, [(a + hit[0], a + hit[1])] if len(spans) == 1 else spans)
        elif scheme and scheme.group(1).lower() == "basic" and _basic_password(scheme.group(2)):
            a = spans[0][0]
            self.report("header", name, [(a + scheme.start(2), a + scheme.end(2))] if len(spans) == 1 else spans)
        elif how == "==" and _password_like(value) and is_secret_value(value) and self.admits(i):
            self.report("compared", name, spans)
        return after

    @staticmethod
    def _looked_up(name: str, value: str) -> bool:
        """A short value that only repeats the thing's name names it and is not it."""
        return re.sub(r"\W|_", "", value).lower() == re.sub(r"\W|_", "", name).lower()

    def characters(self, i: int) -> int:
        """An array of single characters that spells a value."""
        j, spans = i, []
        while self.kind(j) == "string" and len(self.value(j)) in (1, 2):
            spans.append(self.code[j][1:3])
            if self.word(j + 1) != ",":
                j += 1
                break
            j += 2
        value = "".join(self.text[a:b] for a, b in spans)
        if len(spans) >= 6 and is_credential_name(self.target(i)[0]) and not _PLACEHOLDER.search(value):
            self.report("characters", self.target(i)[0], spans)
        return max(j, i + 1)

    def numbers(self, i: int) -> int:
        """A list of character codes or bytes."""
        j, spans, codes = i, [], []
        opener = self.opener[i]
        while j < len(self.code) and self.opener[j] == opener and self.word(j) not in _CLOSES:
            kind, a, b, word = self.code[j]
            if kind == "number":
                try:
                    codes.append(int(word.rstrip("lL"), 0) % 256 if int(word.rstrip("lL"), 0) < 256 else -1)
                except ValueError:
                    codes.append(-1)
                spans.append((a, b))
            elif word == "(" and self.word(j + 1) in ("byte", "char"):
                j = self.partner.get(j, j)
            elif word not in (",", "-"):
                return j
            j += 1
        if len(codes) >= 6 and min(codes) >= 0 and len(set(codes)) >= 4 and any(codes[k + 1] - codes[k] not in (0, 1) for k in range(len(codes) - 1)):
            name = self.target(i)[0]
            if is_credential_name(name) and (len(codes) >= 8 or all(32 <= c < 127 for c in codes)):
                self.report("numbers", name, spans)
        return max(j, i + 1)

    # --- text inside strings and comments ------------------------------------
    def key_blocks(self, parts: list[tuple[int, int]]) -> None:
        """Private keys: from the opening line over one or several literals to the closing line."""
        if "PRIVATE KEY" not in self.text:
            return
        for m in _PEM.finditer(self.text):
            end = _PEM_END.search(self.text, m.end())
            # without its end, a block goes to the end of its base64 run
            stop = end.start() if end else _KEY_RUN.match(self.text, m.end()).end()
            body = [(x.start() + m.end(), x.end() + m.end()) for x in _KEY_LINE.finditer(self.text[m.end():stop])]
            if body and not re.search(r"(?i)x{12,}|\.{3}|your", self.text[m.end():stop]):
                self.report("private key", "", body, m.start())

    def shapes(self, a: int, b: int) -> None:
        """Values inside a literal or a comment that show what they are."""
        part = self.text[a:b]
        for m in _PREFIXED.finditer(part):
            if not _PLACEHOLDER.search(m.group()):
                self.report("token", "", [(a + m.start(), a + m.end())])
        if "://" not in part:
            return
        for m in _URL_USER.finditer(part):
            if not _PLACEHOLDER.search(m.group(2)) and not re.fullmatch(r"[*x.<>-]+|pass(word)?|pwd|secret", m.group(2), re.I):
                self.report("url", m.group(1), [(a + m.start(2), a + m.end(2))])
        for url in _URL.finditer(part):
            for m in _URL_PARAM.finditer(part, *url.span()):
                param = m.group(1)
                named = is_credential_name(param) or param.lower() in ("sig", "signature", "key", "apikey", "access_key", "code")
                if named and is_secret_value(m.group(2)) and (is_credential_name(param) or looks_random(m.group(2))):
                    self.report("url parameter", param, [(a + m.start(2), a + m.end(2))])

    def prose(self, a: int, b: int, comment: bool) -> None:
        """Name-value pairs in a comment or in embedded text."""
        part = self.text[a:b]
        hinted = _HINT.search(part) is not None
        for m in _TEXT_PAIR.finditer(part) if hinted else ():
            name = m.group(1)
            group = 3 if m.group(3) is not None else 4 if m.group(4) is not None else 5
            value = m.group(group)
            low, high = m.span(group)
            if group == 5:
                cut = value.rstrip(").,;}]*/" if comment else "")
                if not comment and value.endswith("*"):
                    cut = value
                high -= len(value) - len(cut)
                value = cut
            if not is_credential_name(name) or not is_secret_value(value):
                continue
            if m.group(2) and m.group(2).lower() == "basic" and not _basic_password(value):
                continue
            self.report("text", name, [(a + low, a + high)])
        for m in _MARKUP.finditer(part) if hinted and "<" in part else ():
            group = 2 if m.group(1) else 4
            if is_credential_name(m.group(group - 1)) and is_secret_value(m.group(group)):
                self.report("text", m.group(group - 1), [(a + m.start(group), a + m.end(group))])
        for m in _SCHEME_IN_TEXT.finditer(part) if hinted else ():
            ok = _basic_password(m.group(2)) if m.group(1).lower() == "basic" else looks_random(m.group(2))
            if ok:
                self.report("header", "", [(a + m.start(2), a + m.end(2))])
        if comment:
            for m in _ACCOUNT_PAIR.finditer(part):
                group = 2 if m.group(2) else 4
                value = m.group(group).rstrip("*/") if group == 2 else m.group(group)
                if value and is_secret_value(value) and "://" not in m.group() and _password_like(value):
                    self.report("account", m.group(group - 1), [(a + m.start(group), a + m.start(group) + len(value))])
            for m in _SPOKEN.finditer(part) if hinted else ():
                value = m.group(1).rstrip(".,;")
                if is_secret_value(value) and _password_like(value):
                    self.report("spoken", "", [(a + m.start(1), a + m.start(1) + len(value))])

    def run(self) -> list[Finding]:
        self.tokenize()
        self.structure()
        literals = [(a, b) for kind, a, b, _ in self.code if kind in _LITERALS]
        self.key_blocks(literals)
        for a, b in self.comments + literals:
            if b - a >= 8:
                self.shapes(a, b)
        for a, b in self.comments:
            self.prose(a, b, True)
        i, n = 0, len(self.code)
        while i < n:
            kind, a, b, _ = self.code[i]
            if kind in _LITERALS:
                if kind == "string" and b - a <= 2 and self.word(i - 1) in ("{", "[", "("):
                    i = self.characters(i)
                    continue
                after = self.literal(i) if kind != "block" else i + 1
                for k in range(i, max(after, i + 1)):
                    if self.kind(k) in _LITERALS and self.code[k][2] - self.code[k][1] > 8:
                        self.prose(*self.code[k][1:3], False)
                i = max(after, i + 1)
                continue
            if self.code[i][3] in _OPENS and (self.kind(i + 1) == "number" or self.word(i + 1) == "-" or self.word(i + 2) in ("byte", "char")):
                i = self.numbers(i + 1)
                continue
            i += 1
        return sorted(self.found)


def _password_like(value: str) -> bool:
    return bool(re.search(r"\d|[^\w./-]", value) or looks_scrambled(value)) and not re.fullmatch(r"[\d.,:/-]+", value)


def find_credentials(text: str | None) -> list[Finding]:
    """All credentials of a text, each once, at the line where its value (or key block) begins.

    Null and empty texts hold none. Texts of any length are read whole.
    """
    return _Scan(text).run() if text else []


_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-7]{1,3}|\r?\n|.)|\r?\n", re.S)


def redact(text: str | None, findings: list[Finding], mask: str = "*") -> str | None:
    """The text with every found value overwritten; escapes and line ends inside a value stay.

    The digits of a list of numbers become 0, so that the list stays one of numbers.
    """
    if not text or not findings:
        return text
    out, at = [], 0
    for a, b, numeric in sorted((*s, f.kind == "numbers") for f in findings for s in f.spans):
        out.append(text[at:a])
        if numeric:
            head = 2 if text[a:a + 2].lower() in ("0x", "0b") else 0
            out += [text[a:a + head], "0" * (b - a - head)]
            at = b
            continue
        pos = a
        for m in _ESCAPE.finditer(text, a, b):
            out += [mask * (m.start() - pos), m.group()]
            pos = m.end()
        out.append(mask * (b - pos))
        at = b
    out.append(text[at:])
    return "".join(out)

def scan_chunks(chunks: DataFrame, id_col: str = "id", text_col: str = "content", at_col: str = "ingested_at",
                with_text: bool = True) -> DataFrame:
    """Findings of the newest version of each text.

    Each delivered row is scanned where it is read; only ids, delivery times and
    findings are shuffled to pick the newest version, with the redacted text if
    `with_text`. Columns: id, lines, kinds, names, redacted (null without findings
    and when not asked for). Null texts have no findings; rows without an id are
    no records; an empty input gives an empty result; other columns are ignored.
    """
    from quarrylens.operators.records import canonical_id

    slim = chunks.select(canonical_id(id_col).alias("id"), F.col(at_col).cast("timestamp_ntz").alias("at"),
                         F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find_credentials(t) for t in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"], "at": batch["at"],
                "lines": [[f.line_no for f in fs] for fs in found],
                "kinds": [[f.kind for f in fs] for fs in found],
                "names": [[f.name for f in fs] for fs in found],
                "redacted": [redact(t, fs) if with_text and fs else None for t, fs in zip(batch["text"], found)],
            })

    rows = slim.mapInPandas(
        scan, "id string, at timestamp_ntz, lines array<int>, kinds array<string>, names array<string>, redacted string")
    fields = ["lines", "kinds", "names", "redacted"]
    version = F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), *fields)
    return rows.groupBy("id").agg(F.max(version).alias("v")).select("id", *[f"v.{f}" for f in fields])
