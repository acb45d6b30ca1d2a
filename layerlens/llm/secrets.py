"""Secret scans: fixed patterns, and an assignment-aware lexer that follows constants to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import joined, slices, text_of

#: The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How much a word in a target's name says that its value is a secret.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "authorization": 0.7, "key": 0.5, "api": 0.3, "access": 0.3, "private": 0.3, "signing": 0.3, "encryption": 0.3,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = re.compile(r"(?:x+|\*+|change_?me|example|none|null|true|false|undefined|your[-_].*|<.*|\$\{.*|\$[A-Za-z_].*|%\(.*|\{\{.*|os\.environ.*|process\.env.*|env\..*|getenv.*)", re.IGNORECASE)
THRESHOLD = 0.6
#: What a literal of one class of characters is worth: enough under a fully sensitive name, too little under a weak one.
ONE_CLASS = 0.8

#: A text without any of these words in any case has no name that scores, one without these signs no pair.
_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "api", "access", "private", "signing", "encryption")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_QUOTED = r"""(?<![A-Za-z0-9_])[bBrRuUfF]{0,2}(?:"{3}(?P<t1>(?s:.*?))(?:"{3}|\Z)|'{3}(?P<t2>(?s:.*?))(?:'{3}|\Z)|"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>(?:[^`\\\n]|\\.)*+)`)"""
#: The lexer: comments and loose strings are passed over, so what stands in them is no pair; an element or a key and value
#: attribute is a pair by itself; a name with its sign opens one.
_LEX = re.compile(
    rf"""(?P<comment>(?:^|(?<=\s))(?:\#|//|--\x20)[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|<!--(?s:.*?)(?:-->|\Z))"""
    rf"""|<(?P<tag>{_NAME})>(?P<inner>[^<>\n]+)</(?P=tag)>"""
    rf"""|<[A-Za-z][^<>\n]*?\s(?:key|name|id)\s*=\s*(?P<kq>["'])(?P<attr>{_NAME})(?P=kq)[^<>\n]*?\svalue\s*=\s*(?P<vq>["'])(?P<given>[^"'<>\n]*)(?P=vq)"""
    rf"""|(?<![A-Za-z0-9_.-])(?P<q>["']?)(?P<name>{_NAME})(?P=q)[\x20\t]*(?::=|=>|=(?![=~])|:(?![:/]))[\x20\t]*"""
    rf"""|(?P<loose>{_QUOTED})""",
    re.MULTILINE,
)
_STRING = re.compile(_QUOTED)
#: What opens a line's configuration entry: nothing, a declaration's word or a list's dash.
_ENTRY = re.compile(r"[\x20\t]*(?:(?:export|set|-)[\x20\t]+)?")
#: Bare values run to white space or a separator; those of entries to white space, less what closes a list or statement.
_BARE = re.compile(r"[A-Za-z0-9+/_.=!@#$%^*~?{}-]+")
_BARE_ENTRY = re.compile(r"[^\s,;)\]}]++(?:[,;)\]}]++[^\s,;)\]}]++)*+\}?")
_CALL = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*(?:\([^\n]{0,200}\)|\[[^\n]{0,200}\])")
#: A name that a sign joins to a string, and a type between a name and its value.
_TERM = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*(?=[\x20\t]*(?:\+|\.\.)[\x20\t]*[\"'])")
_TYPED = re.compile(r"[A-Za-z_][A-Za-z0-9_.<>?]*[\x20\t]*=[\x20\t]*(?=[\"'`])")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_JOIN = re.compile(r"[\x20\t]*(?:\+(?!=)|\.\.)[\x20\t]*(?:\\?\n[\x20\t]*)?|[\x20\t]+(?=[\"'])")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)|%\(([A-Za-z_][A-Za-z0-9_.]*)\)s|\{([A-Za-z_][A-Za-z0-9_.]*)\}")
_LINE = re.compile(r"\n([\x20\t]*)(?=[^\s]|\Z)|[{}]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """0 to 1: the words of snake, kebab, dotted or camel case names, by noisy or; two neighbours also count as one word."""
    words = [w.lower() for w in _WORDS.findall(name)]
    clear = 1.0
    for w in {*words, *map("".join, zip(words, words[1:], strict=False))}:
        clear *= 1 - NAME_WORDS.get(w, 0.0)
    return 1 - clear


def value_score(value: str) -> float:
    """0 to 1: length and entropy of a literal; placeholders and short or plain words score low."""
    if len(value) < 6 or PLACEHOLDERS.fullmatch(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.0) * (1.0 if mixed > 1 else ONE_CLASS)


#: Part of an expression: start and end, the literal's value, and the name it refers to, if it is one.
Part = tuple[int, int, str, str | None]
#: Characters of a joined value that are scored.
SCORED = 10_000


@dataclass
class Pair:
    """A name bound to an expression in a scope, given by the scope's number."""

    name: str
    scope: int
    parts: list[Part]


class Scopes:
    """Blocks by braces and by indentation, numbered as they open, 0 being the whole text.

    The blocks within a block are numbered from its own number on, up to last[number].
    """

    def __init__(self, text: str):
        margin = len(text) - len(text.lstrip(" \t"))
        self.open: list[tuple[int, int]] = []  # indentation (-1: a brace), number
        self.last, self.margin = [0], margin

    def _begin(self, width: int) -> None:
        self.open.append((width, len(self.last)))
        self.last.append(0)

    def _end(self) -> int:
        width, number = self.open.pop()
        self.last[number] = len(self.last) - 1
        return width

    def _indent(self, width: int) -> None:
        while self.open and self.open[-1][0] > width:
            self._end()
        if width > (self.open[-1][0] if self.open else self.margin) and not (self.open and self.open[-1][0] < 0):
            self._begin(width)

    def read(self, gap: str) -> int:
        """The innermost block that is open after gap."""
        for m in _LINE.finditer(gap):
            if m[0] == "{":
                self._begin(-1)
            elif m[0] == "}":
                while self.open and self._end() >= 0:
                    pass
            else:
                self._indent(len(m[1].expandtabs(4)))
        return self.open[-1][1] if self.open else 0

    def close(self) -> list[int]:
        while self.open:
            self._end()
        self.last[0] = len(self.last) - 1
        return self.last


def _parts(text: str, start: int, end: int, refers: bool, escapes: bool) -> list[Part]:
    """A literal's own text, and the names that stand in it for others."""
    out: list[Part] = []
    at = start
    for m in _REFERENCE.finditer(text, start, end) if refers else ():
        out += [(at, m.start(), text[at : m.start()], None)] if at < m.start() else []
        out.append((*m.span(), "", next(filter(None, m.groups()))))
        at = m.end()
    out += [(at, end, text[at:end], None)] if at < end or not out else []
    return [(a, b, _ESCAPE.sub(r"\1", v), r) for a, b, v, r in out] if escapes else out


def _value(text: str, at: int, entry: bool) -> tuple[list[Part], int]:
    """The expression from there on, and where it ends: literals and names, joined by signs or side by side."""
    parts: list[Part] = []
    end = at
    if m := _TYPED.match(text, at):
        at = m.end()
    while True:
        bare = False
        if m := _STRING.match(text, at):
            kind, mark = m.lastgroup, text[m.start() : m.start(m.lastgroup)].lower()
            parts += _parts(text, *m.span(kind), refers="f" in mark or kind == "bq" or kind == "dq" and "$" in m[kind], escapes="r" not in mark)
        elif m := _TERM.match(text, at):
            parts.append((*m.span(), m[0], m[0]))
        elif _CALL.match(text, at):
            return parts, end  # what a call or a subscript gives isn't known
        elif m := (_BARE_ENTRY if entry and not parts else _BARE).match(text, at):
            bare, named = True, re.fullmatch(_NAME, m[0])
            if named and parts and not any(c.isdigit() for c in m[0]):
                parts.append((*m.span(), "", m[0]))
            else:
                parts += [(*m.span(), m[0], m[0])] if named else _parts(text, *m.span(), refers=True, escapes=False)
        else:
            return parts, end
        end = m.end()
        j = _JOIN.match(text, end)
        if not j or bare and not j[0].strip():
            return parts, end
        at = j.end()


def pairs(text: str) -> tuple[list[Pair], list[int]]:
    """The name-literal pairs of source code and configuration, in the order of the text, and the ends of its scopes."""
    out, scopes, at, done, line, seen = [], Scopes(text), 0, 0, 0, 0
    while m := _LEX.search(text, at):
        at = max(m.end(), at + 1)
        scope, done = scopes.read(text[done : m.start()]), m.start()
        if m["comment"] is not None or m["loose"] is not None:
            done = m.end()
        elif m["tag"] is not None:
            out.append(Pair(m["tag"], scope, _parts(text, *m.span("inner"), refers=True, escapes=False)))
        elif m["attr"] is not None:
            out.append(Pair(m["attr"], scope, _parts(text, *m.span("given"), refers=True, escapes=False)))
        else:
            line, seen = max(line, text.rfind("\n", seen, m.start()) + 1), m.start()
            parts, end = _value(text, m.end(), bool(_ENTRY.fullmatch(text, line, m.start())))
            if parts:
                out.append(Pair(m["name"], scope, parts))
                at = done = max(at, end)
    return out, scopes.close()


def _plain(name: str) -> str:
    return name.removeprefix("self.").removeprefix("this.")


def _nearest(every: list[Pair], last: list[int], order: Iterable[int]) -> dict[tuple[int, str], int]:
    """(pair, name) -> the pair of that name passed last, in an open block, when going through the pairs in order.

    A block left in either direction isn't entered again, so what stands in it is dropped for good.
    """
    passed: dict[str, list[int]] = {}
    out: dict[tuple[int, str], int] = {}
    for i in order:
        scope = every[i].scope
        for *_, r in every[i].parts:
            if r is not None and (places := passed.get(_plain(r))):
                while places and not every[places[-1]].scope <= scope <= last[every[places[-1]].scope]:
                    places.pop()
                if places:
                    out[i, r] = places[-1]
        passed.setdefault(_plain(every[i].name), []).append(i)
    return out


def _links(every: list[Pair], last: list[int]) -> list[list[int | None]]:
    """For each pair's parts, the pair that the part's name is bound by: the latest one before it of that name in an open
    block, else the first one after it."""
    before, after = (_nearest(every, last, order) for order in (range(len(every)), range(len(every) - 1, -1, -1)))
    return [[None if r is None else before.get((i, r), after.get((i, r))) for *_, r in p.parts] for i, p in enumerate(every)]


def _values(every: list[Pair], links: list[list[int | None]]) -> list[str]:
    """Each pair's value with constants propagated; a name that reaches itself adds nothing."""
    values: list[str | None] = [None] * len(every)
    for first in range(len(every)):
        todo, begun = [first], set()
        while todo:
            i = todo[-1]
            missing = [j for j in links[i] if j is not None and values[j] is None and j not in begun] if values[i] is None and i not in begun else []
            begun.add(i)
            if missing:
                todo += missing
                continue
            todo.pop()
            if values[i] is None:
                said = (v if r is None or j is None and len(every[i].parts) == 1 else values[j] or "" if j is not None else "" for (_, _, v, r), j in zip(every[i].parts, links[i], strict=True))
                values[i] = "".join(said)[:SCORED]
    return [v or "" for v in values]


def assigned_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals whose value reaches a sensitive name, directly or through constants.

    A pair's value is that of its literals and of the names in it, see _links; a name bound nowhere is a bare literal where
    it stands alone, and nothing within a longer expression.  Each sensitive target scores all the literals that reach it by
    its own name and its value (of a joined one the first SCORED characters); a literal's score is the best of its targets'.
    """
    low = text.lower()
    if not any(x in low for x in _HINTS) or not any(x in text for x in "=:>"):
        return []
    every, last = pairs(text)
    targets = [(name, i) for i, p in enumerate(every) if (name := name_score(p.name)) >= THRESHOLD]
    if not targets:
        return []
    links = _links(every, last)
    values = _values(every, links)
    found: dict[tuple[int, int], float] = {}
    reached: set[int] = set()
    for score, i in sorted(((name * value_score(values[i]), i) for name, i in targets), reverse=True):
        todo = [i] if score >= THRESHOLD else []
        while todo:
            if (at := todo.pop()) in reached:
                continue
            reached.add(at)
            for (a, b, v, r), j in zip(every[at].parts, links[at], strict=True):
                if j is not None:
                    todo.append(j)
                elif a < b and v and (r is None or len(every[at].parts) == 1):
                    found.setdefault((a, b), score)
    return sorted((a, b, s) for (a, b), s in found.items())


def find_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans (kind, start, end) by start and kind, and the spans of the secret values in them."""
    spans, values = [], []
    low = text.lower()
    for m in ASSIGN.finditer(text) if any(x in low for x in _ASSIGN_HINTS) else ():
        if len(m[2]) >= 6:
            spans.append(("assign", *m.span()))
            values.append(m.span(2))
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)] + [("literal", a, b) for a, b, _ in assigned_literals(text)]
    values += [(a, b) for kind, a, b in spans if kind != "assign"]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])), sorted(values)


def redacted(text: str, values: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b in values:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCANNED = "n_assign long, n_access long, n_hex long, n_literal long, base_spans string, spans string, redacted string"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield joined((_scanned(part["text"]) for part in slices(texts.to_frame("text"))), _scanned([]))


def _scanned(texts: Iterable[str]) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans, values = find_secrets(text)
        base = [s for s in spans if s[0] != "literal"]
        count = Counter(s[0] for s in spans)
        rows.append((*(count[k] for k in KINDS), _listed(base), _listed(spans), redacted(text, values) if values else None))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_literal", "base_spans", "spans", "redacted"])


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `secrets`: struct<n_assign, n_access, n_hex, n_literal, base_spans, spans, redacted>.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined.  Base kinds are the fixed
    patterns; kind literal comes from the assignment-aware lexer.  `redacted` is the text with every secret value masked,
    null where nothing was found.  Every text is scanned whole, in its own row.

    Defined results: null and empty texts have no spans; an empty table gives no rows; repeated rows get the same answer
    each; overlapping values are masked once; other columns stay, one named secrets is replaced.
    """
    return docs.withColumn("secrets", F.pandas_udf(_scan, SCANNED)(text_of(text_col)))

