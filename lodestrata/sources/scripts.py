"""What a script text declares: functions, classes with their methods, interfaces, type aliases, imports.

Strings, comments, templates and patterns are blanked out first, character for character, so that
places in the blanked text are places in the text, and brackets can be paired.
"""

from __future__ import annotations

import re

_BLANK = re.compile(
    r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|(?P<pattern>(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*)"
)
_DECLARED = re.compile(
    r"(?m)^(?P<indent>[ \t]*)(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?P<abstract>abstract\s+)?(?P<class>class)\s+(?P<cname>[\w$]+)|(?P<interface>interface)\s+(?P<iname>[\w$]+)|(?P<type>type)\s+(?P<tname>[\w$]+)(?:<[^\n=]*>)?\s*="
    r"|(?P<async>async\s+)?(?P<function>function)\s*\*?\s*(?P<fname>[\w$]+)|(?:const|let|var)\s+(?P<vname>[\w$]+)\s*(?::[^=\n]+)?=\s*(?P<vasync>async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*)?(?:<[^\n(]*>\s*)?(?=\(|[\w$]+\s*=>))"
)
_METHOD = re.compile(
    r"(?m)^[ \t]*(?P<words>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|declare)\s+|\*\s*)*)(?P<name>#?[\w$]+)\s*(?:<[^\n(]*>\s*)?(?:\(|(?::[^=\n]+)?=\s*(?P<arrow>async\s+)?(?:\(|[\w$]+\s*=>))"
)
_CALL = re.compile(r"(?<![\w$.])(?:new\s+)?((?:this\.|super\.)?[\w$]+(?:\??\.[\w$]+)*)\s*(?:<[\w$<>,\[\] ]*>)?\(")
_WORDS = frozenset("if for while switch catch function return typeof await new super import with do else case void delete in of instanceof yield throw async constructor".split())
_IMPORT = re.compile(r"(?m)^[ \t]*import\s+(?P<type>type\s+)?(?:(?P<what>[\w$*{][^;'\"]*?)\s*from\s*)?[\"'](?P<source>[^\"'\n]+)[\"']")
_REQUIRE = re.compile(r"(?m)^[ \t]*(?:const|let|var)\s+(?P<what>[\w$]+|\{[^}]*\})\s*=\s*require\(\s*[\"'](?P<source>[^\"'\n]+)[\"']\s*\)")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def blanked(content: str, strings: bool = True) -> str:
    """The text with comments, and strings and patterns if asked for, as blanks; line breaks stay."""
    keep = lambda m: m[0] if m.lastgroup != "comment" and not strings else re.sub(r"[^\n]", " ", m[0])
    return _BLANK.sub(keep, content)


def _partners(text: str) -> dict[int, int]:
    """Where each opening bracket is closed."""
    found: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(r"[()\[\]{}]", text):
        if m[0] in "([{":
            opened.append(m.start())
        elif opened and text[opened[-1]] == _PAIRS[m[0]]:
            found[opened.pop()] = m.start()
    return found


def _bases(head: str) -> list[str]:
    """Names after extends and implements, in order, without their type arguments."""
    plain = head
    while (shorter := re.sub(r"<[^<>]*>", "", plain)) != plain:
        plain = shorter
    lists = re.findall(r"\b(?:extends|implements)\s+(.+?)(?=\bimplements\b|\{|$)", plain, re.S)
    return [name for part in lists for name in re.findall(r"[\w$]+(?:\.[\w$]+)*", part)]


def _doc(content: str, begin: int) -> str | None:
    """The /** */ comment that ends on the line above."""
    ends = content.rfind("*/", 0, begin)
    opens = content.rfind("/**", 0, begin)
    if opens < 0 or ends < opens or content[ends + 2 : begin].strip() or content.count("\n", ends, begin) != 1:
        return None
    return re.sub(r"(?m)^[ \t]*\*(?!/)[ \t]?", "", content[opens + 3 : ends])


def _calls(text: str, begin: int, end: int) -> list[str]:
    names = {m[1].replace("?.", ".") for m in _CALL.finditer(text, begin, end)}
    return sorted(n for n in names if n.split(".")[0] not in _WORDS or n.startswith("super."))


def _body_end(text: str, partners: dict[int, int], at: int) -> tuple[int, int]:
    """(begin, end) of the body of a function whose parameters begin at `at` or behind it: a block, or an expression up to the end of its statement."""
    opens = text.find("(", at)
    arrow = text.find("=>", at)
    after = partners.get(opens, -1) + 1 if opens >= 0 and (arrow < 0 or opens < arrow) else arrow
    if after <= 0:
        return at, at
    # a type may stand before the block; braces of a type are followed by another one or an arrow
    place = after
    while place < len(text):
        char = text[place]
        if char == "{":
            close = partners.get(place, len(text) - 1)
            rest = text[close + 1 : close + 40].lstrip()
            if rest[:1] in ("{", "|", "&", ">", ",") or rest[:2] in ("=>", "[]"):
                place = close + 1
                continue
            return place, close + 1
        if text.startswith("=>", place):
            begin = place + 2
            stripped = begin + len(text[begin:]) - len(text[begin:].lstrip())
            if text[stripped : stripped + 1] != "{":
                end = stripped
                while end < len(text) and text[end] not in ";\n)]},":
                    end = partners.get(end, end) + 1
                return stripped, end
        if char in "([":
            place = partners.get(place, place)
        elif char == ";" or char == "\n" and not text[after:place].rstrip().endswith((":", "|", "&", "=>", ",")):
            return place, place
        place += 1
    return place, place


def script_entities(content: str) -> list[dict]:
    """Functions, classes, interfaces and type aliases at the top of a script, and the methods of the classes; nothing nested deeper."""
    text = blanked(content)
    partners = _partners(text)
    begins = [0, *(m.end() for m in re.finditer("\n", content))]

    def line(at: int) -> int:
        low, high = 0, len(begins)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if begins[middle] <= at else (low, middle)
        return low + 1

    found: list[dict] = []

    def add(kind: str, name: str, begin: int, end: int, signature: str, owner: str | None = None, bases: list[str] | None = None, calls: list[str] | None = None, words: str = "") -> None:
        found.append(
            {
                "type": kind, "name": name, "local_name": f"{owner}.{name}" if owner else name, "signature": re.sub(r"\s+", " ", signature).strip(), "docstring": _doc(content, begins[line(begin) - 1]),
                "start_line": line(begin), "end_line": line(max(begin, end - 1)), "is_async": "async" in words.split(), "is_static": "static" in words.split(), "is_classmethod": False,
                "decorators": [], "parent_class": owner, "base_classes": bases or [], "calls": calls or [],
            }
        )

    beyond = 0
    for m in _DECLARED.finditer(text):
        begin = m.start() + len(m["indent"])
        if m["indent"] and begin < beyond or begin < beyond:
            continue
        if m["class"] or m["interface"]:
            opens = text.find("{", m.end())
            if opens < 0:
                continue
            close = partners.get(opens, len(text) - 1)
            add("class" if m["class"] else "interface", m["cname"] or m["iname"], begin, close + 1, content[begin:opens], bases=_bases(text[m.end() : opens]))
            inner = opens + 1
            while m["class"] and inner < close:
                method = _METHOD.search(text, inner, close)
                if not method:
                    break
                body, end = _body_end(text, partners, method.start("name"))
                if method["name"] not in _WORDS or method["name"] == "constructor":
                    at = method.start() + len(method[0]) - len(method[0].lstrip())
                    add("method", method["name"], at, end, content[at : body or method.end()].rstrip("=> \n{"), m["cname"], calls=_calls(text, body, end), words=method["words"] + (method["arrow"] or ""))
                inner = max(end, method.end())
            beyond = close + 1
        elif m["type"]:
            add("type_alias", m["tname"], begin, m.end(), content[begin : m.end() - 1])
        else:
            name = m["fname"] or m["vname"]
            body, end = _body_end(text, partners, m.end())
            add("function", name, begin, end, content[begin:body].rstrip("=> \n{"), calls=_calls(text, body, end), words=(m["async"] or "") + (m["vasync"] or ""))
            beyond = end
    return found


def script_imports(content: str) -> list[tuple[str | None, str | None, str, bool, int]]:
    """(name, alias, source, is_external, line) of each name that a script imports, in any form; a star is the name `*`, an import for its effects alone has no name."""
    text = blanked(content, strings=False)
    found = []
    for m in sorted([*_IMPORT.finditer(text), *_REQUIRE.finditer(text)], key=lambda m: m.start()):
        source, line = m["source"], text.count("\n", 0, m.start("source")) + 1
        line = text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
        what = (m["what"] or "").strip()
        external = not source.startswith(".")
        names: list[tuple[str | None, str | None]] = []
        braces = re.search(r"\{([^}]*)\}", what)
        for part in braces[1].split(",") if braces else ():
            pieces = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^\s*type\s+", "", part).strip())
            if pieces[0]:
                names.append((pieces[0], pieces[1] if len(pieces) > 1 else None))
        for part in re.sub(r"\{[^}]*\}", "", what).split(","):
            star = re.match(r"\s*\*\s*as\s+([\w$]+)", part)
            if star:
                names.insert(0, ("*", star[1]))
            elif part.strip():
                names.insert(0, (part.strip(), None))
        found += [(name, alias, source, external, line) for name, alias in names or [(None, None)]]
    return found
