"""A generalised LL recogniser with a graph-structured stack.

A grammar is written as rules in an extended notation. Each nonterminal becomes
an automaton over terminals and nonterminals (a recursive transition network).
Recognition runs over the tokens in step: all descriptors (automaton state, stack
node) of one position are finished before the next token. Calls of the same
nonterminal at the same position share one stack node, so ambiguity costs
polynomial and not exponential time. One token of lookahead prunes the choices;
while a single descriptor is left, its chains of calls are taken from a table.

Several start rules (dialects) can run together: each puts its own descriptor on
the first position, and the text is rejected when no descriptor of any dialect
is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_PIECE = re.compile(r"\s*(?:'([^']+)'|(\$\w+)|(\w+)|([()|*+?;=]))")

#: Zero-width terminal: an omitted semicolon, allowed before '}', at the end, or after a line end.
ASI = "<asi>"
#: Zero-width terminal: the next token stands on the same line.
JOIN = "<join>"
EOF = "EOF"


def _is_call(symbol: str) -> bool:
    return symbol[0] == "@" and len(symbol) > 1


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[str | None, int]]] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1


class Grammar:
    """Rules compiled to prediction tables.

    text: rules `Name = expression ;` with 'terminal', $Class, Name, grouping,
    alternatives and the marks ? * +. classes: terminals of each $Class.
    forbidden: first tokens that a nonterminal must not start with.
    """

    def __init__(self, text: str, classes: dict[str, Iterable[str]], forbidden: dict[str, Iterable[str]] | None = None) -> None:
        self.classes = {k: sorted(set(v)) for k, v in classes.items()}
        self.forbidden = {k: set(v) for k, v in (forbidden or {}).items()}
        self.rules = self._read(text)
        self._compile()

    # --- reading --------------------------------------------------------------
    def _read(self, text: str) -> dict[str, object]:
        pieces: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _PIECE.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            kind = ("t", "c", "n", "o")[next(i for i in range(4) if m.group(i + 1) is not None)]
            pieces.append((kind, m.group(m.lastindex)))
            at = m.end()
        rules: dict[str, object] = {}
        i = 0

        def choice() -> tuple:
            nonlocal i
            options = [sequence()]
            while i < len(pieces) and pieces[i] == ("o", "|"):
                i += 1
                options.append(sequence())
            return ("alt", options) if len(options) > 1 else options[0]

        def sequence() -> tuple:
            nonlocal i
            items = []
            while i < len(pieces) and pieces[i] not in (("o", "|"), ("o", ")"), ("o", ";")):
                kind, value = pieces[i]
                i += 1
                if (kind, value) == ("o", "("):
                    item = choice()
                    if pieces[i] != ("o", ")"):
                        raise ValueError("grammar: ) expected")
                    i += 1
                elif kind == "t":
                    item = ("sym", value)
                elif kind == "c":
                    item = ("any", self.classes[value[1:]])
                elif kind == "n":
                    item = ("sym", "@" + value)
                else:
                    raise ValueError(f"grammar: {value!r} not expected")
                while i < len(pieces) and pieces[i][0] == "o" and pieces[i][1] in "?*+":
                    item = (pieces[i][1], item)
                    i += 1
                items.append(item)
            return ("seq", items)

        while i < len(pieces):
            name = pieces[i][1]
            if pieces[i][0] != "n" or pieces[i + 1] != ("o", "="):
                raise ValueError(f"grammar: rule expected at {name!r}")
            i += 2
            rules[name] = choice()
            i += 1
        return rules

    # --- automata ---------------------------------------------------------------
    def _thompson(self, node: tuple, nfa: _Nfa, start: int) -> int:
        kind = node[0]
        if kind == "sym":
            end = nfa.state()
            nfa.moves[start].append((node[1], end))
            return end
        if kind == "any":
            end = nfa.state()
            nfa.moves[start] += [(t, end) for t in node[1]]
            return end
        if kind == "seq":
            for item in node[1]:
                start = self._thompson(item, nfa, start)
            return start
        if kind == "alt":
            end = nfa.state()
            for item in node[1]:
                s = nfa.state()
                nfa.moves[start].append((None, s))
                nfa.moves[self._thompson(item, nfa, s)].append((None, end))
            return end
        inner = nfa.state()
        nfa.moves[start].append((None, inner))
        done = self._thompson(node[1], nfa, inner)
        end = nfa.state()
        nfa.moves[done].append((None, end))
        if kind in "*+":
            nfa.moves[done].append((None, inner))
        if kind in "?*":
            nfa.moves[start].append((None, end))
        return end

    def _compile(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        self.owner: list[str] = []
        self.entry: dict[str, int] = {}
        for name, body in self.rules.items():
            nfa = _Nfa()
            first = nfa.state()
            last = self._thompson(body, nfa, first)

            def closure(states: frozenset[int], nfa: _Nfa = nfa) -> frozenset[int]:
                seen, todo = set(states), list(states)
                while todo:
                    for sym, to in nfa.moves[todo.pop()]:
                        if sym is None and to not in seen:
                            seen.add(to)
                            todo.append(to)
                return frozenset(seen)

            names: dict[frozenset[int], int] = {}
            todo = [closure(frozenset([first]))]

            def number(states: frozenset[int], name: str = name, names: dict = names, last: int = last) -> int:
                if states not in names:
                    names[states] = len(self.moves)
                    self.moves.append({})
                    self.accepts.append(last in states)
                    self.owner.append(name)
                return names[states]

            self.entry[name] = number(todo[0])
            done = set()
            while todo:
                states = todo.pop()
                if states in done:
                    continue
                done.add(states)
                here = number(states)
                by: dict[str, set[int]] = {}
                for s in states:
                    for sym, to in nfa.moves[s]:
                        if sym is not None:
                            by.setdefault(sym, set()).add(to)
                for sym, to in by.items():
                    target = closure(frozenset(to))
                    self.moves[here][sym] = number(target)
                    todo.append(target)
        for name, state in self.entry.items():
            if self.accepts[state]:
                raise ValueError(f"grammar: {name} may be empty")
        self._sets()

    def _sets(self) -> None:
        """First sets of nonterminals and states, follow sets of nonterminals, as bit masks of terminals."""
        marks = sorted({s for m in self.moves for s in m if not _is_call(s)})
        bit = {t: 1 << i for i, t in enumerate(marks)}
        hidden = {n: sum(bit.get(t, 0) for t in ts) for n, ts in self.forbidden.items()}
        self.first = dict.fromkeys(self.rules, 0)
        changed = True
        while changed:
            changed = False
            for name, state in self.entry.items():
                found = self._starts(state, bit) & ~hidden.get(name, 0)
                if found != self.first[name]:
                    self.first[name] = found
                    changed = True
        starts = [self._starts(s, bit) for s in range(len(self.moves))]
        self.follow = dict.fromkeys(self.rules, 0)
        calls = [(self.owner[state], sym[1:], to) for state, moves in enumerate(self.moves) for sym, to in moves.items() if _is_call(sym)]
        changed = True
        while changed:
            changed = False
            for owner, callee, to in calls:
                found = self.follow[callee] | starts[to] | (self.follow[owner] if self.accepts[to] else 0)
                if found != self.follow[callee]:
                    self.follow[callee] = found
                    changed = True
        self.bit = bit
        # Columns: two for each kind, the second for a token after a line end. Cells are computed when they are first met.
        terminals = [t for t in marks if t not in (ASI, JOIN)]
        self.kinds = {k: i for i, k in enumerate(terminals)}
        self.terminals = terminals
        self.table: list[dict[int, tuple]] = [{} for _ in self.moves]
        self.step: list[dict[int, tuple | int | bool | None]] = [{} for _ in self.moves]

    def _starts(self, state: int, bit: dict[str, int]) -> int:
        found = 0
        for sym in self.moves[state]:
            found |= self.first[sym[1:]] if _is_call(sym) else bit[sym]
        return found

    def actions(self, state: int, col: int) -> tuple:
        """What a state can do before the token of a column."""
        acts = self.table[state].get(col)
        if acts is not None:
            return acts
        kind, newline = self.terminals[col >> 1], col & 1
        can_omit = bool(newline) or kind in ("}", EOF)
        reach = self.bit[kind] | (self.bit.get(ASI, 0) if can_omit else 0) | (0 if newline else self.bit.get(JOIN, 0))
        found = []
        for sym, to in self.moves[state].items():
            if sym == ASI:
                if can_omit:
                    found.append(("go", to, -1))
            elif sym == JOIN:
                if not newline:
                    found.append(("go", to, -1))
            elif _is_call(sym):
                if self.first[sym[1:]] & reach:
                    found.append(("call", self.entry[sym[1:]], to))
            elif sym == kind:
                found.append(("shift", to, -1))
        if self.accepts[state] and self.follow[self.owner[state]] & reach:
            found.append(("pop", -1, -1))
        self.table[state][col] = acts = tuple(found)
        return acts

    def _chain(self, state: int, col: int) -> tuple | int | bool | None:
        """Calls up to the shift as one step, as long as there is one choice only.

        (returns, state, shifted); a pop is None, several choices are False, no choice is 0.
        """
        returns: list[int] = []
        at = state
        while True:
            now = self.actions(at, col)
            if len(now) != 1:
                result = (0 if not now else False) if not returns and at == state else (tuple(returns), at, False)
                break
            kind, to, back = now[0]
            if kind == "shift":
                result = (tuple(returns), to, True)
                break
            if kind == "pop":
                result = None if not returns and at == state else (tuple(returns), at, False)
                break
            if kind == "call":
                returns.append(back)
            at = to
            if len(returns) > 200:
                raise ValueError("grammar: left recursion without a choice")
        self.step[state][col] = result
        return result

    # --- recognition ------------------------------------------------------------
    def columns(self, tokens: Iterable[tuple[str, bool]]) -> list[int]:
        """Table columns of tokens (kind, after a line end); -1 for kinds the grammar lacks."""
        kinds = self.kinds
        return [2 * kinds[k] + nl if k in kinds else -1 for k, nl in tokens]

    def accepts_tokens(self, columns: list[int], starts: Iterable[str]) -> int:
        """-1 if one of the start rules derives the tokens, else the position no rule could pass."""
        table, step = self.table, self.step
        bottom: list = []
        live: list[tuple[int, list]] = [(self.entry[s], bottom) for s in starts]
        for pos, col in enumerate(columns):
            if col < 0:
                return pos
            if len(live) == 1:
                state, node = live[0]
                single = True
                while True:
                    what = step[state].get(col, -1)
                    if what == -1:
                        what = self._chain(state, col)
                    if what is None:
                        if len(node) != 1:
                            single = False
                            break
                        state, node = node[0]
                    elif what is False:
                        single = False
                        break
                    elif what == 0:
                        return pos
                    else:
                        returns, state, shifted = what
                        for back in returns:
                            node = [(back, node)]
                        if shifted:
                            break
                if single:
                    live = [(state, node)]
                    continue
                live = [(state, node)]
            # general case: a worklist over all descriptors of this position
            seen = {(s, id(n)) for s, n in live}
            work = list(live)
            made: dict[int, list] = {}
            after: dict[tuple[int, int], tuple[int, list]] = {}
            while work:
                state, node = work.pop()
                acts = table[state].get(col)
                for kind, to, back in acts if acts is not None else self.actions(state, col):
                    if kind == "shift":
                        after[to, id(node)] = (to, node)
                        continue
                    if kind == "call":
                        callee = made.get(to)
                        if callee is None:
                            callee = made[to] = [(back, node)]
                            item = (to, callee)
                        else:
                            if not any(b == back and n is node for b, n in callee):
                                callee.append((back, node))
                            continue
                        if (to, id(callee)) not in seen:
                            seen.add((to, id(callee)))
                            work.append(item)
                        continue
                    if kind == "go":
                        if (to, id(node)) not in seen:
                            seen.add((to, id(node)))
                            work.append((to, node))
                        continue
                    for item in node:
                        key = (item[0], id(item[1]))
                        if key not in seen:
                            seen.add(key)
                            work.append(item)
            if not after:
                return pos
            live = list(after.values())
        return -1
