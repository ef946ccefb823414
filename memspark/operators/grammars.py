"""Symbols of languages with braces: a scanner over text whose comments and strings are blanked out.

Definitions are found by patterns outside of any other block, their ends by matching braces; classes and
the like are searched again for members. It reads real code, not every corner of each grammar: what no
pattern knows is left out, never an error.
"""

from __future__ import annotations

import re

_ID = r"[A-Za-z_$][\w$]*"
_BLOCK, _LINE, _DOUBLE, _SINGLE, _CHAR, _BACK = r"/\*.*?(?:\*/|\Z)", r"//[^\n]*", r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'", r"`(?:[^`\\]|\\.)*`"
_SCRIPT = re.compile("|".join((_BLOCK, _LINE, _DOUBLE, _SINGLE, _BACK)), re.S)
_TYPED = re.compile("|".join((_BLOCK, _LINE, _DOUBLE, _CHAR)), re.S)
_GOLANG = re.compile("|".join((_BLOCK, _LINE, _DOUBLE, _CHAR, r"`[^`]*`")), re.S)
LITERALS = {"javascript": _SCRIPT, "typescript": _SCRIPT, "go": _GOLANG, "rust": _TYPED, "java": _TYPED, "c": _TYPED, "cpp": _TYPED}

_EXPORT = r"(?:export\s+(?:default\s+)?)?"
_JAVA_WORDS = r"(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|native|default)\s+)*"
_RUST_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_FN = ("function", rf"{_RUST_PUB}(?:(?:async|const|unsafe)\s+)*fn\s+(?P<name>{_ID})")
_C_CALL = r"\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)"
_C_FUNCTION = ("function", rf"^[ \t]*(?:[A-Za-z_][\w:<>,*&]*[ \t*&\n]+)+?[*&]*(?P<name>~?{_ID}(?:::~?{_ID})*){_C_CALL}\s*(?:(?:const|noexcept|override|final)\s*)*(?=\{{)")
_JS = (
    ("function", rf"{_EXPORT}(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})"),
    ("class", rf"{_EXPORT}(?:abstract\s+)?class\s+(?P<name>{_ID})"),
    ("function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=;\n]+)?=>|{_ID}\s*=>)"),
)
_JS_MEMBER = (("method", rf"(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?[ \t]*(?P<name>#?{_ID})\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;\n]+)?(?=\{{)"),)
_TS = (("class", rf"(?:export\s+)?interface\s+(?P<name>{_ID})"), ("class", rf"(?:export\s+)?type\s+(?P<name>{_ID})\s*(?:<[^=\n]*>)?\s*="))
_JAVA_TYPE = ("class", rf"{_JAVA_WORDS}(?:class|interface|enum|record)\s+(?P<name>{_ID})")
_CLASS = ("class", rf"(?:class|struct)\s+(?P<name>{_ID})[^;{{}}()=]*(?=\{{)")
#: Definitions by language: (kind, pattern) at the top and inside classes. ``inside`` blocks are searched through.
TOP = {
    "javascript": _JS, "typescript": (*_JS, *_TS),
    "go": (("function", rf"^func\s+(?P<name>{_ID})\s*(?=[(\[])"), ("method", rf"^func\s*\([^)]*\)\s*(?P<name>{_ID})"), ("class", rf"^type\s+(?P<name>{_ID})\s+(?:struct|interface)\b")),
    "rust": (_FN, ("class", rf"{_RUST_PUB}(?:struct|enum)\s+(?P<name>{_ID})"), ("inside", rf"{_RUST_PUB}mod\s+{_ID}\s*(?=\{{)"), ("members", rf"impl\b(?:\s*<[^{{;]*?>)?\s+(?:[^{{;]*?\bfor\s+)?(?:\w+::)*(?P<name>{_ID})")),
    "java": (_JAVA_TYPE,),
    "c": (_CLASS, _C_FUNCTION, ("inside", r"extern\s+(?=\{)")),
    "cpp": (_CLASS, _C_FUNCTION, ("inside", r"extern\s+(?=\{)"), ("inside", r"namespace\s*[\w:]*\s*(?=\{)")),
}
MEMBERS = {
    "javascript": _JS_MEMBER, "typescript": _JS_MEMBER, "go": (), "rust": (_FN,), "c": (),
    "java": (_JAVA_TYPE, ("method", rf"{_JAVA_WORDS}(?:<[^>\n]+>\s+)?(?:[\w<>\[\],.?]+\s+)?(?P<name>{_ID})\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w,.\s]+)?(?=\{{)")),
    "cpp": (_CLASS, ("method", rf"(?:[\w:<>,*&~]+[ \t*&]+)*(?P<name>~?{_ID}){_C_CALL}\s*(?:(?:const|noexcept|override|final)\s*)*(?::[^;{{}}]*)?(?=\{{)")),
}
_COMPILED = {where: {lang: [(kind, re.compile(p, re.M)) for kind, p in ps] for lang, ps in table.items()} for where, table in (("top", TOP), ("members", MEMBERS))}
#: Words before a bracket that call nothing.
NO_CALL = set("if for while switch catch return sizeof function fn func match loop else do new typeof await super constructor".split())
#: Words that may stand before a bracket and a block but name no definition.
NO_NAME = set("if for while switch catch return sizeof else do".split())
_CALL = re.compile(rf"({_ID})\s*\(")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _close(masked: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(masked)


def _body(masked: str, at: int, limit: int) -> tuple[int, int]:
    """From the end of a header: (place of the opening brace or -1, end of the definition)."""
    depth = 0
    for m in re.compile(r"[(){};\n]").finditer(masked, at, limit):
        c = m[0]
        if c in "()":
            depth += 1 if c == "(" else -1
        elif depth <= 0 and c == "{":
            return m.start(), _close(masked, m.start())
        elif depth <= 0 and (c == ";" or c == "}"):
            return -1, m.end() if c == ";" else m.start()
        elif depth <= 0 and c == "\n" and masked[at : m.start()].strip() and not masked[m.start() : limit].lstrip()[:1] == "{":
            return -1, m.start()
    return -1, limit


def symbols(source: str, language: str, max_lines: int = 40) -> list[dict]:
    """Definitions in order, classes before what they define."""
    comments = [m for m in LITERALS[language].finditer(source) if m[0][:2] in ("//", "/*")]
    masked, out = LITERALS[language].sub(_blank, source), []

    def note(kind, name, parent, start, end, opened):
        text = source[start:end].rstrip()
        head = text.split("\n", 1)[0].split("{", 1)[0].rstrip().removesuffix("=>").strip()
        before = [c for c in comments if c.end() <= start and not source[c.end() : start].strip()]
        doc = before[-1][0].strip().lstrip("#/*").strip() if before else ""
        line = source.count("\n", 0, start) + 1
        # of a class only its members call; of others what follows the header
        calls = [] if kind == "class" else [c for c in _CALL.findall(masked[opened:end]) if c not in NO_CALL]
        kept = "\n".join(text.split("\n")[: max_lines if max_lines > 0 else 40])
        out.append({"symbol_kind": kind, "name": name, "parent": parent, "signature": f"class {name}" if kind == "class" else head, "docstring": doc, "line_start": line, "line_end": line + text.count("\n"), "body": kept, "calls": calls})
        return out[-1]

    def scan(begin, limit, parent, where):
        at = begin
        while at < limit:
            found = [(m.start(), k, kind, m) for k, (kind, p) in enumerate(_COMPILED[where][language]) if (m := p.search(masked, at, limit)) and m.end() > m.start()]
            brace = masked.find("{", at, limit)
            if not found:
                return
            start, _, kind, m = min(found, key=lambda f: f[:2])
            if -1 < brace < start:
                at = _close(masked, brace)
                continue
            name = m.groupdict().get("name") or ""
            start += len(m[0]) - len(m[0].lstrip())
            if name in NO_NAME:
                at = m.end()
                continue
            opened, end = _body(masked, m.end(), limit)
            if kind in ("inside", "members"):
                if opened >= 0:
                    scan(opened + 1, end - 1, name or parent, "members" if kind == "members" else where)
            else:
                made = note(kind, name, parent, start, end, m.end() if opened < 0 else opened)
                if kind == "class" and opened >= 0:
                    mine = len(out)
                    scan(opened + 1, end - 1, f"{parent}.{name}" if parent else name, "members")
                    made["calls"] = [c for s in out[mine:] for c in s["calls"]]
            at = max(end, m.end())

    scan(0, len(masked), "", "top")
    return out
