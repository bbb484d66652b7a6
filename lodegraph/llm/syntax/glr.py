"""Parsing tables from grammars in EBNF, and a generalised LR recogniser over them.

Notation: `name = a 'b' | c? ;`. Quoted strings and UPPER names are terminals. `x?`,
`x*`, `x+` and ( ) are as usual; `x % y` is one or more x with y in between, `x %% y` the
same with a y allowed at the end. The first rule is the start.

The tables are SLR(1). Where an entry holds several actions the recogniser goes on with a
graph-structured stack, which follows all of them at once and merges what agrees; as soon
as one stack is left, it goes on with that alone.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:('(?:[^'\\]|\\.)+')|([A-Za-z_][A-Za-z_0-9]*)|(%%|[=|;()?*+%]))")


class Grammar:
    """Productions as tuples of symbol numbers; terminals come first, 0 is the end."""

    def __init__(self, text: str):
        self.rules: dict[str, list[list[str]]] = {}
        self.made: dict[tuple, str] = {}
        self._read(text)
        names = {s for alts in self.rules.values() for alt in alts for s in alt}
        self.terminals = ["$end", *sorted(s for s in names if s not in self.rules)]
        bad = [s for s in self.terminals if not (s[0] == "$" or s[0] == "'" or s.isupper())]
        if bad:
            raise ValueError(f"undefined: {bad}")
        self.number = {s: i for i, s in enumerate([*self.terminals, *self.rules])}
        #: Terminal numbers by what a lexer calls them: the text of a literal or the name.
        self.token = {(t[1:-1].replace("\\'", "'").replace("\\\\", "\\") if t[0] == "'" else t): i for i, t in enumerate(self.terminals)}
        self.first_nt = len(self.terminals)
        self.heads, self.bodies, self.of = [], [], {}
        for name, alts in self.rules.items():
            for alt in {tuple(self.number[s] for s in alt): 0 for alt in alts}:
                self.of.setdefault(self.number[name], []).append(len(self.heads))
                self.heads.append(self.number[name])
                self.bodies.append(alt)

    def _read(self, text: str) -> None:
        tokens, at, end = [], 0, len(text.rstrip())
        while at < end:
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.tokens, self.i = tokens, 0
        self.start = tokens[0]
        while self.i < len(tokens):
            name = tokens[self.i]
            if tokens[self.i + 1] != "=":
                raise ValueError(f"grammar: no = after {name}")
            self.i += 2
            self.rules[name] = self._alternatives()
            if tokens[self.i] != ";":
                raise ValueError(f"grammar: {name} doesn't end: {tokens[self.i]}")
            self.i += 1

    def _alternatives(self) -> list[list[str]]:
        alts = [[]]
        while (t := self.tokens[self.i]) not in (";", ")"):
            if t == "|":
                self.i += 1
                alts.append([])
                continue
            alts[-1].append(self._item())
        return alts

    def _item(self) -> str:
        x = self._atom()
        while (t := self.tokens[self.i]) in ("?", "*", "+", "%", "%%"):
            self.i += 1
            sep = self._atom() if t[0] == "%" else ""
            x = self._make((x, t, sep))
        return x

    def _atom(self) -> str:
        t = self.tokens[self.i]
        self.i += 1
        if t != "(":
            return t
        alts = self._alternatives()
        self.i += 1
        return alts[0][0] if len(alts) == 1 and len(alts[0]) == 1 else self._make(("(", *map(tuple, alts)))

    def _make(self, key: tuple) -> str:
        if key not in self.made:
            name = self.made[key] = f"_{len(self.made)}"
            if key[0] == "(":
                self.rules[name] = [list(a) for a in key[1:]]
            else:
                x, op, sep = key
                self.rules[name] = {"?": [[], [x]], "*": [[], [name, x]], "+": [[x], [name, x]], "%": [[x], [name, sep, x]], "%%": None}[op]
                if op == "%%":
                    inner = self._make((x, "%", sep))
                    self.rules[name] = [[inner], [inner, sep]]
        return self.made[key]


class Tables:
    """action[state][terminal]: state to shift to, or ~production to reduce, or a tuple of
    several; goto[state][nonterminal]."""

    def __init__(self, text: str):
        g = self.grammar = Grammar(text)
        self.token = g.token
        nt, bodies, heads = g.first_nt, g.bodies, g.heads
        start = g.number[g.start]
        nullable, changed = set(), True
        while changed:
            changed = False
            for h, b in zip(heads, bodies):
                if h not in nullable and all(s in nullable for s in b):
                    nullable.add(h)
                    changed = True
        first = {s: {s} if s < nt else set() for s in range(len(g.number))}
        follow: dict[int, set[int]] = {s: set() for s in range(nt, len(g.number))}
        follow[start].add(0)
        for grow in (self._first, self._follow):
            while grow(g, first, follow, nullable):
                pass
        # nonterminals that can begin what a nonterminal derives
        begins = {s: {s} for s in range(nt, len(g.number))}
        changed = True
        while changed:
            changed = False
            for h, b in zip(heads, bodies):
                for s in b:
                    if s < nt:
                        break
                    if not begins[s] <= begins[h]:
                        begins[h] |= begins[s]
                        changed = True
                    break
        fresh = {s: [p for x in sorted(begins[s]) for p in g.of[x]] for s in begins}
        kernels: dict[frozenset, int] = {}
        work: list[frozenset] = []

        def state(kernel: frozenset) -> int:
            if kernel not in kernels:
                kernels[kernel] = len(kernels)
                work.append(kernel)
            return kernels[kernel]

        # items are (production, dot); production -1 is the start
        state(frozenset({(-1, 0)}))
        self.action: list[dict] = []
        self.goto: list[dict] = []
        i = 0
        while i < len(work):
            moves: dict[int, set] = {}
            done: set[int] = set()
            action: dict[int, list[int]] = {}
            added: set[int] = set()
            for p, dot in work[i]:
                body = (start,) if p < 0 else bodies[p]
                if dot == len(body):
                    if p >= 0:
                        done.add(p)
                    else:
                        action[0] = [0]  # accept: state 0 is never shifted to
                    continue
                s = body[dot]
                moves.setdefault(s, set()).add((p, dot + 1))
                if s >= nt and s not in added:
                    added.add(s)
            seen: set[int] = set()
            for s in added:
                for p in fresh[s]:
                    if p in seen:
                        continue
                    seen.add(p)
                    if bodies[p]:
                        moves.setdefault(bodies[p][0], set()).add((p, 1))
                    else:
                        done.add(p)
            goto = {}
            for s, kernel in moves.items():
                to = state(frozenset(kernel))
                if s < nt:
                    action.setdefault(s, []).append(to)
                else:
                    goto[s] = to
            for p in sorted(done):
                for t in follow[heads[p]]:
                    action.setdefault(t, []).append(~p)
            self.action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in action.items()})
            self.goto.append(goto)
            i += 1
        self.sizes = [len(b) for b in bodies]
        self.heads = heads

    @staticmethod
    def _first(g, first, follow, nullable) -> bool:
        before = sum(map(len, first.values()))
        for h, b in zip(g.heads, g.bodies):
            for s in b:
                first[h] |= first[s]
                if s not in nullable:
                    break
        return sum(map(len, first.values())) > before

    @staticmethod
    def _follow(g, first, follow, nullable) -> bool:
        before = sum(map(len, follow.values()))
        for h, b in zip(g.heads, g.bodies):
            tail = follow[h]
            for s in reversed(b):
                if s >= g.first_nt:
                    follow[s] |= tail
                    tail = first[s] | tail if s in nullable else first[s]
                else:
                    tail = first[s]
        return sum(map(len, follow.values())) > before

    def parse(self, tokens: list[int], breaks: set[int] | None = None, semicolon: int = -1, closing: int = -1) -> int:
        """Index of the first token that no continuation of the text before it allows, or -1.

        tokens: terminal numbers without the end. breaks: indices of tokens before which
        a semicolon may be supplied where the text goes on in no other way (as also
        before the closing brace and the end).
        """
        return _Run(self, tokens, breaks, semicolon, closing).run()


class _Node:
    __slots__ = ("base", "below", "state")

    def __init__(self, state: int, below: list, base: int = -1):
        self.state, self.below, self.base = state, below, base


class _Run:
    def __init__(self, tables: Tables, tokens: list[int], breaks, semicolon: int, closing: int):
        self.t, self.tokens = tables, [*tokens, 0]
        self.breaks, self.semicolon, self.closing = breaks, semicolon, closing
        self.lazy: dict[int, _Node] = {}

    def run(self) -> int:
        action, goto, sizes, heads = self.t.action, self.t.goto, self.t.sizes, self.t.heads
        tokens, breaks, semicolon = self.tokens, self.breaks, self.semicolon
        stack, i, n = [0], 0, len(self.tokens)
        supplied = -1
        while i < n:
            tok = tokens[i]
            may = breaks is not None and supplied != i and (tok == self.closing or tok == 0 or i in breaks)
            saved = stack[:] if may else None
            while True:
                a = action[stack[-1]].get(tok)
                if a.__class__ is int:
                    if a < 0:
                        p = ~a
                        k = sizes[p]
                        if k:
                            del stack[-k:]
                        stack.append(goto[stack[-1]][heads[p]])
                        continue
                    if tok == 0:
                        return -1
                    stack.append(a)
                    i += 1
                    break
                if a is None:
                    if may:
                        stack, supplied = self._supply(saved), i
                        if stack is None:
                            return i
                        if stack.__class__ is dict:
                            i, stack = self._graph(stack, i, supplied)
                            if stack is None:
                                return i
                        break
                    return i
                # several actions: follow them all until one stack is left
                base = saved if saved is not None else stack
                if saved is not None:
                    stack = saved
                i, stack = self._graph({stack[-1]: self._on(stack)}, i, supplied)
                if stack is None:
                    return i
                break
        return -1

    def _supply(self, stack: list[int]):
        """The stack after a semicolon; a frontier where that takes several; None."""
        self._on(stack)
        frontier = self._advance({stack[-1]: self.lazy[len(stack) - 1]}, self.semicolon)
        if not frontier:
            return None
        single = self._single(frontier)
        return single if single is not None else frontier

    def _on(self, stack: list[int]) -> _Node:
        """The top node of a graph whose lower part is the stack."""
        self.base = stack[:]
        top = _Node(stack[-1], None, len(stack) - 1)
        self.lazy = {len(stack) - 1: top}
        return top

    def _below(self, node: _Node) -> list[_Node]:
        if node.below is None:
            k = node.base - 1
            node.below = [self.lazy.setdefault(k, _Node(self.base[k], None, k))] if k >= 0 else []
        return node.below

    def _paths(self, node: _Node, k: int) -> list[_Node]:
        ends = [node]
        for _ in range(k):
            if len(ends) == 1:
                ends = self._below(ends[0])
            else:
                ends = list({id(x): x for e in ends for x in self._below(e)}.values())
        return ends

    def _advance(self, frontier: dict[int, _Node], tok: int) -> dict[int, _Node]:
        """All reductions before a token, then its shift."""
        action, goto, sizes, heads = self.t.action, self.t.goto, self.t.sizes, self.t.heads
        frontier = dict(frontier)
        work = list(frontier.values())
        reducing = []
        while work:
            node = work.pop()
            a = action[node.state].get(tok)
            if a is None:
                continue
            reductions = [x for x in (a if a.__class__ is tuple else (a,)) if x < 0]
            if not reductions:
                continue
            if node not in reducing:
                reducing.append(node)
            for r in reductions:
                p = ~r
                head = heads[p]
                for end in self._paths(node, sizes[p]):
                    to = goto[end.state].get(head)
                    if to is None:
                        continue
                    known = frontier.get(to)
                    if known is None:
                        known = frontier[to] = _Node(to, [end])
                        work.append(known)
                    elif end not in self._below(known):
                        if known.base >= 0:
                            # the graph's lower part stays as it is; branch above it
                            copy = _Node(to, list(self._below(known)))
                            frontier[to] = known = copy
                        known.below.append(end)
                        # the new link may complete reductions made before it
                        work += [x for x in reducing if x not in work]
                        if known not in work:
                            work.append(known)
        if tok == 0:
            return {0: node for node in frontier.values() if 0 in self._shifts(node.state, 0)}
        out: dict[int, _Node] = {}
        for node in frontier.values():
            for to in self._shifts(node.state, tok):
                if to in out:
                    out[to].below.append(node)
                else:
                    out[to] = _Node(to, [node])
        return out

    def _shifts(self, state: int, tok: int) -> list[int]:
        a = self.t.action[state].get(tok)
        return [] if a is None else [x for x in (a if a.__class__ is tuple else (a,)) if x >= 0]

    def _single(self, frontier: dict[int, _Node]) -> list[int] | None:
        """The stack of a frontier that has only one."""
        if len(frontier) > 1:
            return None
        (node,) = frontier.values()
        above = []
        while node.base < 0:
            above.append(node.state)
            if len(node.below) != 1 or len(above) > 200:
                return None
            node = node.below[0]
        return self.base[: node.base + 1] + above[::-1]

    def _graph(self, frontier: dict[int, _Node], i: int, supplied: int) -> tuple[int, list[int] | None]:
        """Go on with several stacks: (next token, the one stack left), or (error, None)."""
        tokens = self.tokens
        while True:
            tok = tokens[i]
            after = self._advance(frontier, tok)
            if not after:
                if self.breaks is not None and supplied != i and (tok == self.closing or tok == 0 or i in self.breaks):
                    supplied = i
                    frontier = self._advance(frontier, self.semicolon)
                    if frontier:
                        continue
                return i, None
            i += 1
            if tok == 0:
                return i, [0]
            frontier = after
            stack = self._single(frontier)
            if stack is not None:
                return i, stack
