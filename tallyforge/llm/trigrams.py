"""Boolean trigram queries from regular expressions.

``clauses(pattern)`` gives alternatives, each a set of lower-cased trigrams:
every text that the pattern matches holds, in lower case, all trigrams of at
least one alternative. None means that nothing is mandatory and every text must
be searched. The expression is read with Python's own regex parser; what cannot
be written out as a few literal strings only ends the literal run it stands in.
"""

from __future__ import annotations

from itertools import product
from re import _constants as code
from re import _parser as parser

#: A pattern's literal runs are written out up to this many strings; beyond it a run ends, which only loosens the query.
MOST = 32


def clauses(pattern: str) -> list[frozenset[str]] | None:
    groups: list[set[frozenset[str]]] = []
    open_run = _walk(parser.parse(pattern), {""}, groups)
    _close(open_run, groups)
    if not groups:
        return None
    found: set[frozenset[str]] = {frozenset()}
    for group in sorted(groups, key=len):
        if len(found) * len(group) > MOST:
            continue  # leaving out a conjunct keeps every match
        found = {a | b for a, b in product(found, group)}
    # A clause that holds another one's trigrams adds nothing.
    return sorted((c for c in found if not any(other < c for other in found)), key=sorted)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _close(run: set[str], groups: list[set[frozenset[str]]]) -> None:
    """Ends a literal run; it constrains only if every string of it has a trigram."""
    if all(len(s) >= 3 for s in run):
        groups.append({_trigrams(s) for s in run})


def _walk(items, run: set[str], groups: list[set[frozenset[str]]]) -> set[str]:
    """Extends the run of possible literal strings over a sequence; returns the run left open."""
    for op, arg in items:
        options = _strings([(op, arg)])
        if options is not None and len(run) * len(options) <= MOST:
            run = {a + b for a, b in product(run, options)}
            continue
        _close(run, groups)
        run = options if options is not None and len(options) <= MOST else {""}
        if options is None and op is code.SUBPATTERN:
            _close(_walk(arg[3], {""}, groups), groups)
        elif options is None and op is code.MAX_REPEAT and arg[0] >= 1:
            _close(_walk(arg[2], {""}, groups), groups)
    return run


def _strings(items) -> set[str] | None:
    """Every lower-cased string a sequence can match, if they are few; else None."""
    out = {""}
    for op, arg in items:
        if op is code.LITERAL:
            step = {chr(arg).lower()}
        elif op is code.SUBPATTERN:
            step = _strings(arg[3])
        elif op is code.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            step = None if None in parts else set().union(*parts)
        elif op is code.MAX_REPEAT and arg[1] == 1:
            once = _strings(arg[2])
            step = None if once is None else once | ({""} if arg[0] == 0 else set())
        elif op is code.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
            once = _strings(arg[2])
            step = None if once is None or len(once) != 1 else {next(iter(once)) * arg[0]}
        elif op is code.IN:
            step = _class(arg)
        else:
            step = None
        if step is None or len(out) * len(step) > MOST:
            return None
        out = {a + b for a, b in product(out, step)}
    return out


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is code.LITERAL:
            out.add(chr(arg).lower())
        elif op is code.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None
