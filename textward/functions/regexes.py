"""What a Java regular expression's text tells before it runs: literals that every match holds, and how its backtracking can grow.

The JVM matches; here an expression is only read into a small tree. Whatever is not surely understood is taken for the worst: a
character class that nests or intersects others may hold any character, and an expression with unknown parts has no literals.

A clock would judge the same text differently from run to run, so work is bounded by an estimate. With n the text's length and m that of
its longest stretch of characters that the loops take:

* a search begins at n places; an unbounded loop that a begin can fall into costs a factor m (`scan` counts such loops and 1 for the
  begin), as `\\s+$` does on spaces;
* loops that can share a stretch, each with the next, cost m each (`chain`), as `\\s*,?\\s*x` does; stretches of loops that no begin can fall
  into are disjoint, so all begins together cost n for the first of them;
* a loop around what can match a stretch in two ways costs 2**m, as `(a+)+$` does;
* a repetition between two bounds costs their distance (`factor`).

Loops after which nothing has to come succeed when they are reached, and a word boundary keeps begins out of words; neither is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = 128  # stands for every character beyond ASCII
ALL = frozenset(range(OTHER + 1))
_DIGIT = frozenset(range(48, 58))
_WORD = _DIGIT | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
_SPACE = frozenset(map(ord, " \t\n\x0b\f\r"))
_BLANK = frozenset(map(ord, " \t")) | {OTHER}
_LINE = frozenset(map(ord, "\n\x0b\f\r")) | {OTHER}
_SETS = {"d": _DIGIT, "w": _WORD, "s": _SPACE, "h": _BLANK, "v": _LINE}
_CONTROL = {"t": 9, "n": 10, "r": 13, "f": 12, "a": 7, "e": 27}
#: Positions that an expression may be unrolled to; beyond, repeated parts count as loops.
MOST = 120


class Unknown(ValueError):
    """An expression with parts that are not understood."""


@dataclass(frozen=True)
class Node:
    """kind: char, seq, alt, repeat, look (around), edge (an assertion), word (a word boundary) or back (a reference)."""

    kind: str
    parts: tuple[Node, ...] = ()
    chars: frozenset[int] = frozenset()
    source: str = ""
    literal: str = ""
    least: int = 0
    most: int | None = None


def _char(code: int, source: str) -> Node:
    if code >= OTHER:
        return Node("char", chars=frozenset([OTHER]), source=source)
    c = chr(code)
    chars = {code, ord(c.lower()), ord(c.upper())} | ({OTHER} if c.lower() in "iks" else set())  # which have twins beyond ASCII
    return Node("char", chars=frozenset(chars), source=source, literal=c.lower())


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.p, self.at, self.dot = pattern, 0, ALL - {10}

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        if len(got) < n:
            raise Unknown(self.p)
        self.at += n
        return got

    def until(self, end: str) -> str:
        k = self.p.find(end, self.at)
        if k < 0:
            raise Unknown(self.p)
        return self.take(k + len(end) - self.at)[: -len(end)]

    def alternatives(self) -> Node:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Node("alt", tuple(parts))

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.peek() not in ("", "|", ")"):
            if self.peek(2) == "\\Q":
                self.take(2)
                parts += [_char(ord(c), f"\\Q{c}\\E") for c in (self.until("\\E") if "\\E" in self.p[self.at :] else self.take(len(self.p) - self.at))]
                continue
            parts.append(self.quantified(self.atom()))
        return Node("seq", tuple(parts))

    def quantified(self, node: Node) -> Node:
        while (c := self.peek()) and (c in "*+?" or c == "{"):
            self.take()
            if c == "{":
                low, comma, high = self.until("}").partition(",")
                if not low.isdecimal() or high and not high.isdecimal():
                    raise Unknown(self.p)
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            if self.peek() in ("?", "+") and self.peek():
                self.take()
            node = Node("repeat", (node,), least=least, most=most)
        return node

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == "\\":
            return self.escape()
        if c == ".":
            return Node("char", chars=self.dot, source="[^\n]")
        if c in "^$":
            return Node("edge")
        if c in "*+?{":
            raise Unknown(self.p)
        return _char(ord(c), "\\" + c if not c.isalnum() and ord(c) < OTHER else c)

    def group(self) -> Node:
        kind = "seq"
        if self.peek() == "?":
            self.take()
            c = self.take()
            if c in "=!" or c == "<" and self.peek() in ("=", "!"):
                if c == "<":
                    self.take()
                kind = "look"
            elif c == "<":
                self.until(">")
            elif c not in ":>":
                flags = c
                while (c := self.take()) not in "):":
                    flags += c
                if set(flags) - set("imsud-"):
                    raise Unknown(self.p)
                if "s" in flags:
                    self.dot = ALL
                if c == ")":
                    return Node("seq")
        inner = self.alternatives()
        if self.take() != ")":
            raise Unknown(self.p)
        return Node("look", (inner,)) if kind == "look" else inner

    def escape(self) -> Node:
        c = self.take()
        if c.lower() in _SETS:
            own = _SETS[c.lower()]
            return Node("char", chars=own if c.islower() else ALL - own | {OTHER}, source="\\" + c)
        if c in "bB":
            if self.peek() == "{":
                raise Unknown(self.p)
            return Node("word" if c == "b" else "edge")
        if c in "AzZG":
            return Node("edge")
        if c in "pP":
            name = "{" + (self.take() and self.until("}")) + "}" if self.peek() == "{" else self.take()
            return Node("char", chars=ALL, source=f"\\{c}{name}")
        if c == "k":
            self.take()
            self.until(">")
            return Node("back")
        if c.isdecimal() and c != "0":
            while self.peek().isdecimal():
                self.take()
            return Node("back")
        code, source = self.code(c)
        return _char(code, source)

    def code(self, c: str) -> tuple[int, str]:
        """The character that an escape names."""
        begun = self.at - 2
        if c in _CONTROL:
            return _CONTROL[c], "\\" + c
        try:
            if c == "x":
                code = int(self.take() and self.until("}"), 16) if self.peek() == "{" else int(self.take(2), 16)
            elif c == "u":
                code = int(self.take(4), 16)
            elif c.isalnum():
                raise Unknown(self.p)  # octal and control characters among them
            else:
                code = ord(c)
        except ValueError as error:
            raise Unknown(self.p) from error
        return code, self.p[begun : self.at]

    def char_class(self) -> Node:
        begun = self.at - 1
        negated = self.peek() == "^"
        if negated:
            self.take()
        chars: set[int] = set()
        count, first, plain = 0, True, True
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            first = False
            if c == "[" or c == "&" and self.peek() == "&" or c == "\\" and self.peek() == "Q":
                return self.nested(begun)
            if c == "\\":
                e = self.take()
                if e.lower() in _SETS:
                    own = _SETS[e.lower()]
                    chars |= own if e.islower() else ALL - own | {OTHER}
                    plain = False
                    continue
                if e in "pP":
                    _ = self.take() == "{" and self.until("}")
                    chars |= ALL
                    plain = False
                    continue
                low, _ = self.code(e)
            else:
                low = ord(c)
            high = low
            if self.peek() == "-" and self.peek(2) not in ("-]", "-[", "-\\"):
                self.take()
                high = ord(self.take())
            elif self.peek(2) == "-\\":
                self.take(2)
                high, _ = self.code(self.take())
            count += 1
            for x in range(low, min(high, OTHER - 1) + 1):
                chars |= _char(x, "").chars
            if high >= OTHER:
                chars.add(OTHER)
            plain = plain and low == high
        source = self.p[begun : self.at]
        if negated:
            return Node("char", chars=frozenset(ALL - chars | {OTHER}), source=source)
        literal = min(chars) if plain and count == 1 else OTHER
        return Node("char", chars=frozenset(chars), source=source, literal=chr(literal).lower() if literal < OTHER else "")

    def nested(self, begun: int) -> Node:
        """A class that holds others, or an intersection: any character."""
        self.at, depth = begun, 0
        while True:
            c = self.take()
            if c == "\\":
                if self.take() == "Q":
                    self.until("\\E")
            elif c == "[":
                depth += 1
                if self.peek() == "^":
                    self.take()
                if self.peek() == "]":
                    self.take()
            elif c == "]":
                depth -= 1
                if not depth:
                    return Node("char", chars=ALL, source=self.p[begun : self.at])


@lru_cache(maxsize=100_000)
def read(pattern: str) -> Node | None:
    """The expression's tree; None if it is not understood."""
    reader = _Reader(pattern)
    try:
        tree = reader.alternatives()
    except (Unknown, RecursionError):
        return None
    return tree if reader.at == len(pattern) else None


# ---- literals


def literals(pattern: str) -> list[str]:
    """Lower-case texts of ASCII one of which every match of the expression holds, whatever the case; none if that can't be told."""
    tree = read(pattern)
    return sorted(_needed(tree)) if tree is not None else []


def _best(options: list[set[str]]) -> set[str]:
    return max((o for o in options if o), key=lambda o: (min(map(len, o)), -len(o)), default=set())


def _flat(node: Node) -> Iterator[Node]:
    if node.kind != "seq":
        yield node
        return
    for part in node.parts:
        yield from _flat(part)


def _needed(node: Node) -> set[str]:
    options: list[set[str]] = []
    run = ""
    for part in [*_flat(node), Node("edge")]:
        if part.kind == "char" and part.literal:
            run += part.literal
            continue
        options.append({run} if run else set())
        run = ""
        if part.kind == "alt":
            each = [_needed(p) for p in part.parts]
            options.append(set().union(*each) if all(each) else set())
        elif part.kind == "repeat" and part.least >= 1:
            (inner,) = part.parts
            own = _needed(inner)
            options.append({x * part.least for x in own} if inner.kind == "char" else own)
    return _best(options)


def heads(pattern: str) -> list[str]:
    """Texts of ASCII with one of which every match begins; none if that can't be told or they are shorter than two characters."""

    def of(node: Node) -> tuple[list[str], bool]:
        """And whether the node is these texts only."""
        if node.kind in ("edge", "word", "look"):
            return [""], True
        if node.kind == "char":
            return [node.literal], bool(node.literal)
        if node.kind == "alt":
            each = [of(p) for p in node.parts]
            return [h for hs, _ in each for h in hs], all(whole for _, whole in each)
        if node.kind == "repeat":
            return (of(node.parts[0])[0], False) if node.least else ([""], False)
        if node.kind != "seq":
            return [""], False
        done = [""]
        for part in node.parts:
            more, whole = of(part)
            done = [a + b for a in done for b in more]
            if not whole or len(done) > 50:
                return done, False
        return done, True

    tree = read(pattern)
    found = sorted(set(of(tree)[0])) if tree is not None else []
    return found if found and min(map(len, found)) >= 2 else []


# ---- how work grows


@dataclass(frozen=True)
class Bound:
    """kind: linear, polynomial, exponential or unknown; alphabet: the body of a character class that holds all that the loops take."""

    kind: str
    scan: int = 1
    chain: int = 1
    factor: float = 1.0
    alphabet: str = ""
    heads: tuple[str, ...] = ()

    def steps(self, n: float, m: float, begins: float | None = None) -> float:
        """The estimate for a text of n characters whose longest stretch has m."""
        begins = n if begins is None else begins
        if self.kind == "exponential":
            return n + begins * self.factor * 2.0 ** min(m, 900)
        return n * m ** (self.scan - 1) + self.factor * min(n * m ** max(0, self.chain - 1), begins * max(m, 1) ** self.chain)


class _Places:
    """The expression's places (characters and loops) and what may follow what, after Glushkov. Outermost loops are one place each where
    `loops` is set; otherwise loops lead back."""

    def __init__(self, loops: bool) -> None:
        self.loops = loops
        self.nodes: list[Node] = []
        self.follow: list[list[int]] = []
        self.after_word: set[int] = set()

    def add(self, node: Node) -> int:
        self.nodes.append(node)
        self.follow.append([])
        return len(self.nodes) - 1

    def build(self, node: Node) -> tuple[list[int], list[int], bool, bool]:
        """First and last places, whether it may be empty, and whether an assertion stands in it."""
        if node.kind == "char":
            k = self.add(node)
            return [k], [k], False, False
        if node.kind in ("edge", "word", "look", "back"):
            return [], [], True, True
        if node.kind == "alt":
            each = [self.build(p) for p in node.parts]
            return [x for f, _, _, _ in each for x in f], [x for _, la, _, _ in each for x in la], any(e for _, _, e, _ in each), any(a for _, _, _, a in each)
        if node.kind == "repeat":
            return self.repeated(node)
        first: list[int] = []
        last: list[int] = []
        empty, word, asserted = True, False, False
        for part in node.parts:
            if part.kind == "word":
                word = asserted = True
                continue
            f, la, e, a = self.build(part)
            for x in last:
                self.follow[x] += f
            if word and not first:
                self.after_word |= set(f)
            if empty:
                first = first + f
            last = la + last if e else la
            empty, word, asserted = empty and e, word and e, asserted or a
        return first, last, empty, asserted

    def repeated(self, node: Node) -> tuple[list[int], list[int], bool, bool]:
        (inner,) = node.parts
        if self.loops and node.most != 1:
            if node.most is None or node.most > node.least:
                k = self.add(node)
                return [k], [k], node.least == 0, False
        if node.most is not None and len(self.nodes) + node.most * _size(inner) <= MOST or node.most == 1:
            parts = [inner] * node.least + [Node("repeat", (inner,), most=1)] * (node.most - node.least if node.most > 1 else 0)
            if parts:
                return self.build(Node("seq", tuple(parts)))
            f, la, _, a = self.build(inner)
            return f, la, True, a
        f, la, e, a = self.build(inner)
        for x in la:
            self.follow[x] += f
        return f, la, e or node.least == 0, a


def _size(node: Node) -> int:
    return 1 if node.kind == "char" else sum(map(_size, node.parts)) * (node.most or node.least or 1 if node.kind == "repeat" else 1)


def _chars(node: Node) -> frozenset[int]:
    return node.chars if node.kind == "char" else frozenset().union(*map(_chars, node.parts))


def _sources(node: Node) -> list[str]:
    if node.kind == "char":
        return [node.source]
    return [s for p in node.parts for s in _sources(p)]


def _loops(node: Node) -> Iterator[Node]:
    """The outermost unbounded repetitions."""
    if node.kind == "repeat" and node.most is None:
        yield node
        return
    for p in node.parts:
        yield from _loops(p)


def _doubled(loop: Node) -> bool:
    """Whether a stretch can run through the loop and back in two ways."""
    if loop.parts[0].kind == "char":
        return False
    g = _Places(loops=False)
    g.build(loop)
    n = len(g.nodes)
    if n > MOST:
        return True
    meets = [[bool(g.nodes[a].chars & g.nodes[b].chars) for b in range(n)] for a in range(n)]
    step = lambda pair: {(x, y) for x in g.follow[pair[0]] for y in g.follow[pair[1]] if meets[x][y]}
    if any(len(f) > len(set(f)) and any(x in _reached(g.follow, x, y) for y in set(f) if f.count(y) > 1) for x, f in enumerate(g.follow)):
        return True
    seen: dict[tuple[int, int], set[tuple[int, int]]] = {}
    back: dict[tuple[int, int], set[tuple[int, int]]] = {}
    todo = [(q, q) for q in range(n)]
    while todo:
        pair = todo.pop()
        if pair in seen:
            continue
        seen[pair] = step(pair)
        for to in seen[pair]:
            back.setdefault(to, set()).add(pair)
            todo.append(to)
    for q in range(n):
        ahead, behind = _reach(seen, (q, q)), _reach(back, (q, q))
        if any(a != b for a, b in ahead & behind):
            return True
    return False


def _reached(follow: list[list[int]], to: int, start: int) -> set[int]:
    found, todo = set(), [start]
    while todo:
        x = todo.pop()
        if x not in found:
            found.add(x)
            todo += follow[x]
    return found if to in found else set()


def _reach(edges: dict, start: tuple[int, int]) -> set[tuple[int, int]]:
    found, todo = set(), [start]
    while todo:
        for x in edges.get(todo.pop(), ()):
            if x not in found:
                found.add(x)
                todo.append(x)
    return found


def _factor(node: Node) -> float:
    if node.kind == "seq":
        out = 1.0
        for p in node.parts:
            out *= _factor(p)
        return out
    if node.kind == "repeat":
        (body,) = node.parts
        inner = _factor(body)
        if node.most is None or node.most <= 1:
            return inner
        if body.kind != "char" and (_empty(body) or _doubled(Node("repeat", node.parts))):
            return max(inner, 2.0) ** min(node.most, 500)  # each time round in one way or another
        return inner * (node.most - node.least + 1)
    return max(map(_factor, node.parts), default=1.0)


def _empty(node: Node) -> bool:
    """Whether nothing matches it."""
    if node.kind == "alt":
        return any(map(_empty, node.parts))
    return node.kind != "char" and (node.kind == "repeat" and not node.least or all(map(_empty, node.parts)))


def _has(node: Node, kind: str) -> bool:
    return node.kind == kind or any(_has(p, kind) for p in node.parts)


def may_be_empty(pattern: str) -> bool:
    """Whether the expression may match nothing at all."""
    tree = read(pattern)
    return tree is None or _empty(tree)


@lru_cache(maxsize=100_000)
def bound(pattern: str) -> Bound:
    """How the work of searching for the expression grows."""
    tree = read(pattern)
    if tree is None:
        return Bound("unknown", scan=2, chain=2)
    g = _Places(loops=True)
    first, last, _, asserted = g.build(tree)
    n = len(g.nodes)
    over = [_chars(x) for x in g.nodes]
    loops = [k for k, x in enumerate(g.nodes) if x.kind == "repeat" and x.most is None]
    # a loop after which the expression may end, asserting nothing, succeeds when it is reached
    counted = [k for k in loops if asserted or k not in last]
    if not counted:
        own = _factor(tree)
        # without loops a begin costs the same whatever the text
        return Bound("polynomial", 1, 2, own) if _has(tree, "back") else Bound("linear", chain=0, factor=own, heads=tuple(heads(pattern)))
    optional = lambda k: g.nodes[k].kind == "repeat" and g.nodes[k].least == 0

    def connected(starts: list[int], chars: frozenset[int]) -> set[int]:
        """Places that can be come to through places whose characters are among chars."""
        found, todo = set(), list(starts)
        while todo:
            x = todo.pop()
            if x in found:
                continue
            found.add(x)
            if over[x] & chars:
                todo += g.follow[x]
        return found

    @lru_cache(maxsize=None)
    def longest(k: int) -> int:
        return 1 + max((longest(j) for j in counted if j != k and over[k] & over[j] and j in connected(g.follow[k], over[k] & over[j]) and k not in connected(g.follow[j], over[k] & over[j])), default=0)

    begins = [k for k in counted if k in connected(first, over[k]) and not (k in g.after_word and over[k] & _WORD)]
    scan = 1 + max((longest(k) for k in begins), default=0)
    chain = max(longest(k) for k in counted) + _has(tree, "back")
    alphabet = "".join(dict.fromkeys(s for k in counted for s in _sources(g.nodes[k])))
    kind = "linear" if scan == 1 and chain == 1 else "polynomial"
    if any(_doubled(g.nodes[k]) for k in counted):
        kind = "exponential"
    return Bound(kind, scan, chain, _factor(tree), alphabet, tuple(heads(pattern)))


def worst(pattern: str, length: int) -> float:
    """The estimate for the worst text of that length."""
    b = bound(pattern)
    return b.steps(float(length), float(length))


def over_budget(low: Column, text: Column, pattern: str, budget: float, length: int) -> Column | None:
    """Whether searching for the expression may take more than `budget` steps; None if no text of up to `length` characters can. `low` is
    the folded text."""
    b = bound(pattern)
    if b.steps(float(length), float(length)) <= budget:
        return None
    n = F.length(text).cast("double")
    if b.alphabet:
        stretches = F.regexp_extract_all(text, F.lit(f"(?iud)([{b.alphabet}]+)"), 1)
        m = F.coalesce(F.array_max(F.transform(stretches, lambda x: F.length(x))), F.lit(0)).cast("double")
    else:
        m = n
    begins = n
    if b.heads:
        begins = sum((((F.length(low) - F.length(F.replace(low, F.lit(h), F.lit("")))) / len(h)).cast("double") for h in b.heads), F.lit(0.0))
    if b.kind == "exponential":
        steps = n + begins * b.factor * F.pow(F.lit(2.0), F.least(m, F.lit(900.0)))
    else:
        steps = n * F.pow(m, F.lit(float(b.scan - 1))) + b.factor * F.least(n * F.pow(m, F.lit(float(max(0, b.chain - 1)))), begins * F.pow(F.greatest(m, F.lit(1.0)), F.lit(float(b.chain))))
    return steps > budget
