"""Parse tables from grammars, and a generalised LR recogniser that keeps several stacks where the table has a conflict.

A grammar is text: ``name: alternative | alternative ;`` with 'literals',
UPPER-CASE token classes, names, groups ( | ), and the suffixes ? * +.
``x // ','`` is a list of x with separators. ANY stands for every token
of the grammar but brackets.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

_PIECE = re.compile(r"\s*(?:#[^\n]*\n\s*)*(//|'(?:[^'\\]|\\.)+'|[A-Za-z_]\w*|[:;|()?*+])")
BRACKETS = frozenset("()[]{}")
END = "$end"


class Grammar:
    """Productions in plain form: nonterminal -> list of tuples of symbols; terminals begin with a quote or are upper case."""

    def __init__(self, text: str) -> None:
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self._pieces = _PIECE.findall(text.strip() + "\n")
        self._at = 0
        self._made: dict[tuple, str] = {}
        self.start = self._pieces[0]
        while self._at < len(self._pieces):
            name = self._take()
            self._expect(":")
            self.rules.setdefault(name, []).extend(self._alternatives())
            self._expect(";")
        self.terminals = sorted({s for alts in self.rules.values() for a in alts for s in a if self.is_terminal(s)} - {"ANY"})
        if any("ANY" in a for alts in self.rules.values() for a in alts):
            self.rules["any_"] = [(t,) for t in self.terminals if t[1:-1] not in BRACKETS]
            self.rules = {n: [tuple("any_" if s == "ANY" else s for s in a) for a in alts] for n, alts in self.rules.items()}
        missing = {s for alts in self.rules.values() for a in alts for s in a if not self.is_terminal(s)} - set(self.rules)
        if missing:
            raise ValueError(f"undefined: {sorted(missing)}")
        self.rules = {n: list(dict.fromkeys(alts)) for n, alts in self.rules.items()}

    @staticmethod
    def is_terminal(s: str) -> bool:
        return s[0] == "'" or s.isupper()

    def _take(self) -> str:
        self._at += 1
        return self._pieces[self._at - 1]

    def _peek(self) -> str:
        return self._pieces[self._at] if self._at < len(self._pieces) else ""

    def _expect(self, s: str) -> None:
        if (got := self._take()) != s:
            raise ValueError(f"expected {s}, got {got} near {' '.join(self._pieces[max(0, self._at - 9) : self._at + 3])}")

    def _named(self, kind: str, body: tuple, rules: list[tuple[str, ...]]) -> str:
        key = (kind, body)
        if key not in self._made:
            self._made[key] = name = f"{kind}{len(self._made)}_"
            self.rules[name] = [tuple(name if s is None else s for s in r) for r in rules]
        return self._made[key]

    def _alternatives(self) -> list[tuple[str, ...]]:
        out = self._sequence()
        while self._peek() == "|":
            self._take()
            out += self._sequence()
        return out

    def _sequence(self) -> list[tuple[str, ...]]:
        seqs: list[tuple[str, ...]] = [()]
        while self._peek() not in ("|", ")", ";", ""):
            piece = self._item()
            seqs = [s + p for s in seqs for p in piece]
        return seqs

    def _item(self) -> list[tuple[str, ...]]:
        p = self._take()
        if p == "(":
            alts = self._alternatives()
            self._expect(")")
        else:
            alts = [(p,)]
        while self._peek() in ("?", "*", "+", "//"):
            op = self._take()
            if op == "?":
                alts = [*alts, ()]
            elif op == "//":
                sep = self._item()
                one = self._single(alts)
                alts = [(self._named("list", (one, tuple(sep)), [(one,), *[(None, *s, one) for s in sep]]),)]
            else:
                one = self._single(alts)
                alts = [(self._named("many", (one,), [(one,), (None, one)]),), *([()] if op == "*" else [])]
        return alts

    def _single(self, alts: list[tuple[str, ...]]) -> str:
        if len(alts) == 1 and len(alts[0]) == 1:
            return alts[0][0]
        return self._named("any", tuple(alts), list(alts))


class Tables:
    """SLR(1) tables; an entry may have several actions."""

    def __init__(self, grammar: Grammar) -> None:
        g = grammar.rules
        prods: list[tuple[str, tuple[str, ...]]] = [("$start", (grammar.start,))]
        of: dict[str, list[int]] = defaultdict(list)
        for n, alts in g.items():
            for a in alts:
                of[n].append(len(prods))
                prods.append((n, a))
        terminal = Grammar.is_terminal
        nullable: set[str] = set()
        first: dict[str, set[str]] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for n, a in prods:
                before = len(first[n]) + (n in nullable)
                for s in a:
                    first[n] |= {s} if terminal(s) else first[s]
                    if s not in nullable:
                        break
                else:
                    nullable.add(n)
                changed |= before != len(first[n]) + (n in nullable)
        follow: dict[str, set[str]] = defaultdict(set)
        follow["$start"].add(END)
        changed = True
        while changed:
            changed = False
            for n, a in prods:
                after = set(follow[n])
                for s in reversed(a):
                    if terminal(s):
                        after = {s}
                        continue
                    if not after <= follow[s]:
                        follow[s] |= after
                        changed = True
                    after = after | first[s] if s in nullable else set(first[s])
        self.lefts = [n for n, _ in prods]
        self.sizes = [len(a) for _, a in prods]

        def closure(kernel: frozenset[tuple[int, int]]) -> list[tuple[int, int]]:
            items, seen = list(kernel), set()
            for p, d in items:
                rhs = prods[p][1]
                if d < len(rhs) and not terminal(s := rhs[d]) and s not in seen:
                    seen.add(s)
                    items += [(q, 0) for q in of[s] if (q, 0) not in kernel]
            return items

        start = frozenset([(0, 0)])
        ids, queue = {start: 0}, [start]
        self.shift: list[dict[str, int]] = []
        self.goto: list[dict[str, int]] = []
        self.reduce: list[dict[str, tuple[int, ...]]] = []
        for kernel in queue:
            moves: dict[str, set[tuple[int, int]]] = defaultdict(set)
            reduces: dict[str, list[int]] = defaultdict(list)
            for p, d in closure(kernel):
                n, rhs = prods[p]
                if d < len(rhs):
                    moves[rhs[d]].add((p, d + 1))
                else:
                    for t in follow[n]:
                        reduces[t].append(p)
            shift, goto = {}, {}
            for s, items in moves.items():
                k = frozenset(items)
                if k not in ids:
                    ids[k] = len(queue)
                    queue.append(k)
                (shift if terminal(s) else goto)[s] = ids[k]
            self.shift.append(shift)
            self.goto.append(goto)
            self.reduce.append({t: tuple(ps) for t, ps in reduces.items()})
        self.terminals = frozenset(grammar.terminals)


class Recogniser:
    """Feeds tokens to graph-structured stacks.

    A node is a state and the set of nodes below it, so stacks with one top state are one node,
    however many there are: a text never needs more tops than there are states. Equal nodes
    are one, so that what has been parsed once from a set of tops is known.
    """

    #: Nodes and remembered steps after which the memory is emptied, between two texts.
    LIMIT = 400_000

    def __init__(self, tables: Tables) -> None:
        self.t = tables
        self.clear()

    def clear(self) -> None:
        self.state: list[int] = [0]
        self.below: list[frozenset[int]] = [frozenset()]
        self.ids: dict[tuple[int, frozenset[int]], int] = {(0, frozenset()): 0}
        self.sets: dict[frozenset[int], frozenset[int]] = {}
        self.steps: dict[tuple[frozenset[int], str], frozenset[int] | None] = {}
        self.start = frozenset([0])
        self.lines: dict = {}

    def tidy(self) -> None:
        if len(self.state) + len(self.steps) + len(self.lines) > self.LIMIT:
            self.clear()

    def _node(self, state: int, below: frozenset[int]) -> int:
        key = (state, below)
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return n

    def _level(self, stacks: Iterable[int], token: str) -> dict[int, set[int]]:
        """What is below each top state once all reductions before token are made; nodes of this level are written ~state."""
        state, below, lefts, sizes, reduce, goto = self.state, self.below, self.t.lefts, self.t.sizes, self.t.reduce, self.t.goto
        level: dict[int, set[int]] = {}
        for n in stacks:
            level.setdefault(state[n], set()).update(below[n])
        todo = [s for s in level if token in reduce[s]]
        while todo:
            grown = False
            for s in todo:
                for p in reduce[s][token]:
                    if p == 0:
                        continue
                    left, at = lefts[p], {~s}
                    for _ in range(sizes[p]):
                        if len(at) == 1:
                            (m,) = at
                            at = below[m] if m >= 0 else level[~m]
                        else:
                            at = {x for m in at for x in (below[m] if m >= 0 else level[~m])}
                    for m in tuple(at):
                        to = goto[state[m] if m >= 0 else ~m].get(left)
                        if to is None:
                            continue
                        under = level.get(to)
                        if under is None:
                            level[to] = {m}
                            grown = True
                        elif m not in under:
                            under.add(m)
                            grown = True
            # what has come may be reduced in turn, or lies below what was reduced before
            todo = [s for s in level if token in reduce[s]] if grown else []
        return level

    def _freeze(self, level: dict[int, set[int]]) -> Callable[[int], int]:
        """A function from the states of a level to nodes."""
        made: dict[int, int] = {}
        begun: dict[int, int] = {}

        def node(s: int) -> int:
            if s in made:
                return made[s]
            begun[s] = -1
            under = []
            for m in level[s]:
                if m >= 0:
                    under.append(m)
                elif ~m in begun and ~m not in made:  # it lies below itself, by reductions of nothing
                    if begun[~m] < 0:
                        begun[~m] = len(self.state)
                        self.state.append(~m)
                        self.below.append(frozenset())
                    under.append(begun[~m])
                else:
                    under.append(node(~m))
            if begun[s] < 0:
                made[s] = self._node(s, frozenset(under))
            else:
                made[s] = begun[s]
                self.below[made[s]] = frozenset(under)
            return made[s]

        return node

    def step(self, stacks: frozenset[int], token: str) -> frozenset[int] | None:
        """The tops after a token; None if there is none."""
        key = (stacks, token)
        if key in self.steps:
            return self.steps[key]
        shift = self.t.shift
        level = self._level(stacks, token)
        node = self._freeze(level)
        after: dict[int, list[int]] = {}
        for s in level:
            to = shift[s].get(token)
            if to is not None:
                after.setdefault(to, []).append(node(s))
        out = frozenset([self._node(to, frozenset(under)) for to, under in after.items()])
        out = self.sets.setdefault(out, out) if out else None
        self.steps[key] = out
        return out

    def accepts(self, stacks: frozenset[int]) -> bool:
        """Whether the text may end here."""
        final = self.t.goto[0].get(self.t.lefts[1]) if len(self.t.lefts) > 1 else None
        under = self._level(stacks, END).get(final, ())
        return 0 in under or ~0 in under

    def feed(self, stacks: frozenset[int], tokens: Sequence[str]) -> tuple[frozenset[int] | None, int]:
        """(stacks after the tokens, tokens taken); None if one could not be taken."""
        for i, t in enumerate(tokens):
            to = self.step(stacks, t)
            if to is None:
                return None, i
            stacks = to
        return stacks, len(tokens)
