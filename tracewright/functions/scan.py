"""Columnar secret scanning: one pass of a linear-time matcher over an Arrow column finds the few texts that a rule or an
encoded run can concern, and only these are looked at one by one.

The gate is the alternation of all rules (RE2, so no backtracking), with every `\\s` widened and word bounds left out: it
passes all that the rules match, and a rule that RE2 doesn't know is gated by its literals. White space, word bounds and
letter case are Unicode's.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .rules import LITERAL_ID, LITERAL_PRIORITY, RuleSet

#: Runs that may hold an encoded secret: base64 in either alphabet, hex, percent escapes.
ENCODED = {"base64": r"[A-Za-z0-9+/_-]{16,}={0,2}", "hex": r"[0-9A-Fa-f]{16,}", "percent": r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}){3,}"}
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]+")


class Budgets(NamedTuple):
    """What the scan of one text may take. A text that needs more matches, runs or decoded bytes fails; one of
    more bytes is omitted; a longer run is not decoded, and counted."""

    leaf_bytes: int = 64 << 20
    matches: int = 10_000
    runs: int = 65_536
    run_length: int = 65_536
    decoded_bytes: int = 16 << 20


#: Literals beyond which they are looked for by an automaton instead of a pattern.
MANY_LITERALS = 100


class Exhausted(Exception):
    """A text passed a budget."""


def _scoped(pattern: str) -> str:
    return f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else f"(?:{pattern})"


def _widened(pattern: str) -> str:
    """pattern for RE2: no word bounds, and all of Unicode's white space, of which RE2 has ASCII's (left as it is where a
    class excludes it)."""
    out, inside, negated, i = [], False, False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(two if negated else _SPACES if inside else f"[{_SPACES}]")
        elif two != r"\b" or inside:
            out.append(two if pattern[i] == "\\" else pattern[i])
        if pattern[i] == "\\":
            i += 2
            continue
        if not inside:
            inside, negated = pattern[i] == "[", two == "[^"
        elif pattern[i] == "]":
            inside = negated = False
        i += 1
    return "".join(out)


class _Place(NamedTuple):
    at: int
    to: int

    def start(self) -> int:
        return self.at

    def end(self) -> int:
        return self.to


class Literals:
    """Any number of literals as one Aho-Corasick automaton, asked like a compiled pattern that tries the longest first."""

    def __init__(self, literals: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x in literals:
            self.automaton.add_word(x, len(x))
        self.automaton.make_automaton()

    def search(self, text: str) -> _Place | None:
        return next((_Place(end + 1 - n, end + 1) for end, n in self.automaton.iter(text)), None)

    def finditer(self, text: str) -> Iterator[_Place]:
        longest: dict[int, int] = {}
        for end, n in self.automaton.iter(text):
            longest[end + 1 - n] = max(n, longest.get(end + 1 - n, 0))
        at = 0
        for start in sorted(longest):
            if start >= at:
                at = start + longest[start]
                yield _Place(start, at)


class _Either:
    """Whether one of two patterns is found."""

    def __init__(self, one, other):
        self.one, self.other = one, other

    def search(self, text: str):
        return self.one.search(text) or self.other.search(text)


def _gates(rules: RuleSet) -> str:
    parts = [re.escape(x) for x in rules.literals] if len(rules.literals) <= MANY_LITERALS else []
    for r in rules.text_rules():
        widened = _scoped(_widened(r.pattern))
        try:
            pc.match_substring_regex(pa.array(["x"]), widened)
        except pa.ArrowInvalid:
            widened = f"(?i:{'|'.join(map(re.escape, r.prefilter))})"
        parts.append(widened)
    return "|".join(parts)


class Scanner:
    """Finds what rules match in texts and, one level deep, in their encoded runs."""

    def __init__(self, rules: RuleSet, decode: bool = True, budgets: Budgets = Budgets()):
        self.known = [(r.id, r.category, r.priority, re.compile(r.pattern)) for r in rules.text_rules()]
        self.literals = Literals(rules.literals) if len(rules.literals) > MANY_LITERALS else None
        if rules.literals:
            self.known.insert(0, (LITERAL_ID, "configured_credential", LITERAL_PRIORITY, self.literals or re.compile("|".join(map(re.escape, rules.literals)))))
        few = [] if self.literals else map(re.escape, rules.literals)
        self.any = re.compile("|".join([*few, *(_scoped(r.pattern) for r in rules.text_rules())]) or r"(?!)")
        if self.literals:
            self.any = _Either(self.literals, self.any)
        self.runs = [(kind, re.compile(p)) for kind, p in ENCODED.items()] if decode else []
        self.budgets = budgets
        self.gate = _gates(rules) or None
        self.run_gate = "|".join(f"(?:{p})" for p in ENCODED.values()) if decode else None

    def may(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which texts a rule may match, and which hold an encoded run."""
        found = [pc.fill_null(pc.match_substring_regex(col, g), False).to_numpy(zero_copy_only=False) if g else np.zeros(len(col), bool) for g in (self.gate, self.run_gate)]
        if self.literals:
            found[0] |= np.fromiter((t is not None and self.literals.search(t) is not None for t in col.to_pylist()), bool, len(col))
        return found[0], found[1]

    def decoded(self, kind: str, run: str) -> list[str]:
        """The one-level decodings of a run as Latin-1 text; hex of odd length is tried at both alignments."""
        try:
            if kind == "base64":
                plain = run.rstrip("=").translate(str.maketrans("-_", "+/"))
                plain = plain[: len(plain) - (len(plain) % 4 == 1)]
                return [base64.b64decode(plain + "=" * (-len(plain) % 4)).decode("latin-1")]
            text = run.replace("%", "")
            odd = kind == "hex" and len(text) % 2
            return [bytes.fromhex(t[: len(t) // 2 * 2]).decode("latin-1") for t in ([text, text[1:]] if odd else [text])]
        except (ValueError, binascii.Error):
            return []

    def places(self, text: str) -> Iterator[tuple[str, re.Match]]:
        """The encoded runs of each kind. A run of hex is looked for in those of base64 alone, whose characters hold its own."""
        wide = []
        for kind, rx in self.runs:
            for at, to in wide if kind == "hex" else [(0, len(text))]:
                for m in rx.finditer(text, at, to):
                    if kind == "base64":
                        wide.append(m.span())
                    yield kind, m

    def encoded(self, text: str) -> tuple[list[tuple], int]:
        """(start, end, -priority, -length, rule, category) of runs whose decoded text holds a match in one of its printable
        parts, named by the rule of highest priority; and how many runs are too long to be decoded."""
        out, skipped, seen, size = [], 0, 0, 0
        for kind, m in self.places(text):
            seen += 1
            if seen > self.budgets.runs:
                raise Exhausted
            if m.end() - m.start() > self.budgets.run_length:
                skipped += 1
                continue
            best = None
            for whole in self.decoded(kind, m.group()):
                size += len(whole)
                if size > self.budgets.decoded_bytes:
                    raise Exhausted
                for part in _CONTROL.split(whole):
                    if self.any.search(part):
                        hit = next((i, c, p) for i, c, p, rx_ in self.known if rx_.search(part))
                        best = min((-hit[2], hit[0], hit[1]), best or (0, "", ""))
            if best:
                out.append((m.start(), m.end(), best[0], m.start() - m.end(), best[1], best[2]))
        return out, skipped

    def spans(self, text: str, matched: bool = True, encoded: bool = True) -> tuple[list[tuple], int]:
        """Merged spans (start, end, -priority, -length, rule, category), and the number of runs that were not decoded.
        Exhausted is raised for a text that passes a budget."""
        out = []
        for i, c, p, rx in self.known if matched else ():
            for m in rx.finditer(text):
                out.append((m.start(), m.end(), -p, m.start() - m.end(), i, c))
                if len(out) > self.budgets.matches:
                    raise Exhausted
        hidden, skipped = self.encoded(text) if encoded else ([], 0)
        if len(out) + len(hidden) > self.budgets.matches:
            raise Exhausted
        merged: list[tuple] = []
        for s in sorted(out + hidden):
            if merged and s[0] < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]), *min(merged[-1][2:], s[2:]))
            else:
                merged.append(s)
        return merged, skipped


def without_spans(text: str, spans: list[tuple]) -> str:
    """text with each span replaced by `[REDACTED:<rule>]`."""
    out, at = [], 0
    for start, end, _, _, rule, _ in spans:
        out += [text[at:start], f"[REDACTED:{rule}]"]
        at = end
    return "".join([*out, text[at:]])
