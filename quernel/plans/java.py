"""The Java pattern that matches what a parsed pattern matches.

Nothing is left to Java's flags but ``d`` (only a line feed ends a line) and ``U`` (Unicode classes and
word boundaries); dots, anchors, case variants and class operations are written out.
"""

from __future__ import annotations

from quernel.plans.syntax import Alternation, Char, Concat, Dot, Empty, Group, Look, PatternError, Repeat, Set, fold_ranges, parse, variants

PREFIX = "(?dU)"
_LOOKS = {
    "A": r"\A", "z": r"\z", "b": r"\b", "B": r"\B", "<": r"\b(?=\w)", ">": r"\b(?<=\w)", "{": r"(?<!\w)", "}": r"(?!\w)",
}
_PERL = {"d": "0-9", "w": "0-9A-Z_a-z", "s": r"\x{9}-\x{D}\x{20}"}


def _code(k: int) -> str:
    c = chr(k)
    return c if c.isascii() and c.isalnum() else rf"\x{{{k:X}}}"


def _members(ranges: list[tuple[int, int]]) -> str:
    return "".join(_code(lo) if lo == hi else f"{_code(lo)}-{_code(hi)}" for lo, hi in ranges)


def _property(name: str) -> str:
    key, _, value = name.partition("=")
    if value:
        kind = {"script": "IsScript", "sc": "IsScript", "general_category": "general_category", "gc": "general_category"}.get(key.strip().lower())
        if kind is None:
            raise PatternError(f"property {name!r} is not supported")
        return rf"\p{{{'script' if kind == 'IsScript' else kind}={value.strip()}}}"
    categories = {
        "letter": "L", "lowercase_letter": "Ll", "uppercase_letter": "Lu", "titlecase_letter": "Lt", "mark": "M", "number": "N", "decimal_number": "Nd",
        "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C",
    }
    plain = name.strip().replace(" ", "_").replace("-", "_")
    if plain.lower() in categories:
        return rf"\p{{{categories[plain.lower()]}}}"
    if len(plain) <= 2:
        return rf"\p{{{plain[0].upper() + plain[1:].lower()}}}"
    return rf"\p{{Is{plain}}}"


def _set(s: Set) -> str:
    """A bracketed Java class."""
    if s.op != "|":
        a, b = (_set(x) for x in s.items)
        body = {"&&": f"{a}&&{b}", "--": f"{a}&&[^{b}]", "~~": f"[{a}{b}]&&[^{a}&&{b}]"}[s.op]
    else:
        ranges = [item[1:] for item in s.items if not isinstance(item, Set) and item[0] == "range"]
        body = _members(fold_ranges(ranges) if s.fold and ranges else ranges)
        for item in s.items:
            if isinstance(item, Set):
                body += _set(item)
            elif item[0] == "perl":
                body += rf"\{item[1]}" if s.unicode else _PERL[item[1]]
            elif item[0] == "prop":
                body += _property(item[1])
                if s.fold and item[1].lower() in ("lu", "ll", "lt", "uppercase", "lowercase", "lowercase_letter", "uppercase_letter"):
                    body += r"\p{Lu}\p{Ll}\p{Lt}"
        if not body:
            body = r"\x{0}&&[^\x{0}]"
    return f"[^{body}]" if s.negated else f"[{body}]"


def _emit(node: object) -> str:
    if isinstance(node, Empty):
        return ""
    if isinstance(node, Char):
        if node.fold and len(variants(node.char)) > 1:
            return f"[{_members(sorted((ord(c), ord(c)) for c in variants(node.char)))}]"
        return _code(ord(node.char))
    if isinstance(node, Dot):
        return r"[\x{0}-\x{10FFFF}]" if node.newline else r"[^\x{A}]"
    if isinstance(node, Set):
        return _set(node)
    if isinstance(node, Look):
        if node.kind == "^":
            return r"(?<![^\x{A}])" if node.multiline else r"\A"
        if node.kind == "$":
            return r"(?![^\x{A}])" if node.multiline else r"\z"
        return _LOOKS[node.kind]
    if isinstance(node, Group):
        inner = _emit(node.sub)
        return f"(?<{node.name}>{inner})" if node.name and node.name.isalnum() and node.name.isascii() else f"({inner})" if node.captures else f"(?:{inner})"
    if isinstance(node, Repeat):
        count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.least, node.most)) or (f"{{{node.least}}}" if node.least == node.most else f"{{{node.least},{'' if node.most is None else node.most}}}")
        return f"(?:{_emit(node.sub)}){count}{'' if node.greedy else '?'}"
    if isinstance(node, Concat):
        return "".join(_emit(p) if not isinstance(p, Alternation) else f"(?:{_emit(p)})" for p in node.parts)
    if isinstance(node, Alternation):
        return "|".join(_emit(a) for a in node.arms)
    raise TypeError(node)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The Java pattern of a pattern."""
    return PREFIX + _emit(parse(pattern, ignore_case))
