"""Is a text valid in the language of its path's extension?"""

from __future__ import annotations

from quarrylens.llm.syntax.grammars import DIALECTS
from quarrylens.llm.syntax.lexers import lex_ecmascript, lex_java


def extension(path: str | None) -> str:
    """Lower-case extension with its dot, '' without one; both separators count."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def syntax_error(path: str | None, content: str | None) -> str | None:
    """None if some dialect of the extension accepts the content, else a short reason.

    Files of other extensions, and null or blank contents, are never rejected.
    """
    ext = extension(path)
    if ext not in DIALECTS or content is None or not content.strip():
        return None
    make, starts = DIALECTS[ext]
    tokens = lex_java(content) if ext == ".java" else lex_ecmascript(content, ext in (".ts", ".tsx"), ext in (".jsx", ".tsx"))
    if tokens is None:
        return "characters"
    grammar = make()
    failed = grammar.accepts_tokens(grammar.columns(zip(*tokens)), starts)
    return None if failed < 0 else f"token {failed}: {tokens[0][failed]}"
