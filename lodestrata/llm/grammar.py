"""Source files that don't parse.

Every text is lexed into token classes. Its adjacent pairs are rows, anti-joined with the pairs that
the grammar permits; its brackets are rows with the tokens that follow each, whose nesting is
validated by windows, and from which windows reduce every inner pair of brackets to one token, so
that the statements of each block can be judged by the productions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.session import cut, ship

PYTHON, JS, JSX, TS, TSX = "python", "javascript", "jsx", "typescript", "tsx"
#: Languages of extensions, where a row has none.
EXTENSIONS = {"py": PYTHON, "pyi": PYTHON, "js": JS, "mjs": JS, "cjs": JS, "jsx": JSX, "ts": TS, "mts": TS, "cts": TS, "tsx": TSX}

# strings of token classes are one character a token:
# I name, N number, S string, T template (its ends, with what it is made of in parentheses between), R pattern, J L Q element opened, closed, empty, A attributes in parentheses before J or Q; C const, V let and var, F function, K class, E extends,
# r return, t prefix word, o infix word, h while, i other header, g catch, l finally, q try, e else, z do, b break, M import, X export, D default, k case,
# a modifier, y type declaration, f from; w arrow, p ++ and --, u sign, B other operator, d spread, m assignment with an operator; n end of line, « and » more and less indented lines; § anything else; brackets and marks as they are
_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"
_BEFORE = r"(?:(?<=[=(,:;!&|?+{}\[>])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase))\s*+"

#: Reserved words of the script languages by class, and words that are reserved only before certain others.
JS_WORDS = {
    "C": "const", "V": "let var", "F": "function", "K": "class enum", "E": "extends implements", "r": "return yield", "t": "throw new typeof delete await void", "o": "in instanceof",
    "h": "while", "i": "if for switch with", "g": "catch", "l": "finally", "q": "try", "e": "else", "z": "do", "b": "break continue debugger", "M": "import", "X": "export", "D": "default", "k": "case",
}
JS_MODIFIERS, TS_MODIFIERS = "async static get set", "async static get set readonly private public protected declare abstract override accessor"
#: Reserved words of Python by class.
PY_WORDS = {
    "D": "def", "K": "class", "i": "if elif while for with", "e": "else finally", "q": "try", "g": "except", "l": "lambda", "r": "return yield raise", "t": "del assert global nonlocal await",
    "!": "not", "o": "and or in is as", "M": "import", "f": "from", "b": "pass break continue", "a": "async",
}
_CONFLICT = r"^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t][^\n]*)?$"


def _alternatives(words: str) -> str:
    return "|".join(words.split())


# a template or an element is one token as long as no braces lie in those of its expressions; else it is lexed up to them, and they like all others
_SIMPLE = r"\{[^{}`]*+\}"
_TEMPLATE = rf"(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${_SIMPLE})*+"
_ATTRIBUTES = rf"(?:\s++(?:[\w:-]++(?:=(?:{_STRING}|{_SIMPLE}))?+(?![\w:=-])|{_SIMPLE}))*+"
_NAME_OF_TAG = r"<(?:[A-Za-z][\w.:-]*+)?"
_AFTER_OPEN, _AFTER_CLOSE = r"(?:[^<>{}]*+(?=[<{]))?", r"(?:[^<>{}()=;]*+(?=[<{]))?"
_TAGS = rf"(?:{_NAME_OF_TAG}{_ATTRIBUTES}\s*+(?:/>{_AFTER_CLOSE}|(?<!=)>{_AFTER_OPEN})|</[\w.:-]*+\s*+>{_AFTER_CLOSE})"
_TAG_HEAD = rf"{_NAME_OF_TAG}{_ATTRIBUTES}\s++(?:[\w:-]++=)?\{{"
_TEMPLATE_REST = re.compile(rf"({_TEMPLATE})(`|\$\{{)")
_TAG_REST = re.compile(rf"({_ATTRIBUTES})\s*+(?:((?:[\w:-]++=)?\{{)|(?:(/)>{_AFTER_CLOSE}|>{_AFTER_OPEN})({_TAGS}*+)({_TAG_HEAD})?+)")
_ELEMENT = re.compile(rf"</[^>]*+>|{_NAME_OF_TAG}{_ATTRIBUTES}\s*+(?:/?>|(?=[\w:-]*+=?\{{))")
_IN_BRACES = re.compile(rf"{_STRING}|\$?\{{([^{{}}`]*+)\}}")
_IN_TEMPLATE = re.compile(rf"\\[\s\S]|\$\{{([^{{}}`]*+)\}}")


def _script_pattern(language: str) -> re.Pattern[str]:
    typed, elements = language in (TS, TSX), language in (JSX, TSX)
    reserved = _alternatives(" ".join(JS_WORDS.values()))
    name = r"#?[^\W\d][\w$]*+|#?\$[\w$]*+"
    chain = rf"(?:\s*+\??\.\s*+(?:{name}))*+"
    parts = [
        _CONFLICT,
        r"\A#![^\n]*+",
        r"//[^\n]*+|/\*[\s\S]*?\*/",
        _STRING,
        rf"`{_TEMPLATE}(?:`|\$\{{)",
        rf"{_BEFORE}/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*+{chain}",
    ]
    if elements:
        parts += [rf"(?:(?<=\}})[^<>{{}}()=;]*+(?=<[/A-Za-z>])|{_BEFORE}|^\s*+|(?=</))(?:{_TAGS}++(?:{_TAG_HEAD})?+|{_TAG_HEAD})"]
    parts += [
        rf"(?<=[{{,])\s*+(?:{reserved})(?=\s*+:)",
        # blanks before what doesn't look back, and words that no reserved word looks like: most of a text
        rf"[ \t]*+(?:[A-Z][\w$]*+|[a-z]++[A-Z\d_$][\w$]*+){chain}",
        r"[ \t]++(?=[\w$\"'`(){}\[\];,=+*&|!-])",
        r"void\s+0\b",
        rf"(?<![\w$.])(?:{_alternatives(TS_MODIFIERS if typed else JS_MODIFIERS)})[ \t]++(?=[\w$\[*{{\"'#])",
        r"(?<![\w$.])of[ \t]++(?=\S)|(?<![\w$.])from\s*+(?=[\"'])",
    ]
    if typed:
        parts += [r"(?<![\w$.])(?:type|interface|namespace|module)[ \t]++(?=[\w$\"'{])", r"(?<![\w$.])(?:keyof|infer|unique|asserts)[ \t]++(?=\S)", r"(?<![\w$.])(?:as|satisfies|is)\s++(?=[\w$\[{(\"'])"]
    else:
        parts += [r"(?<![\w$.])as\s++(?=[\w$\"'])"]
    parts += [
        rf"(?<=[)\]}}\"'`!])\s*+\??\.\s*+(?:{name}){chain}",
        rf"(?:{reserved})(?![\w$])(?!\s*+\??\.\s*+[^\W\d])",
        rf"(?:{name}){chain}",
        r"0[xXbBoO][\da-fA-F_]++n?|\d[\d_]*+(?:\.[\d_]*+)?(?:[eE][+-]?\d++)?n?|\.\d[\d_]*+(?:[eE][+-]?\d++)?",
        r"[ \t\f\r ]*+\n\s*+",
        r"\?\.(?=[(\[])|\.\.\.|=>|\+\+|--|===?|!==?|<=|(?:>>>?|<<|\*\*|&&|\|\||\?\?|[-+*/%&|^])=|\*\*|&&|\|\||\?\?|<<|[^\s]",
    ]
    return re.compile("|".join(parts), re.M)


_PY_STRING = r"(?:[rRbBuUfF]{1,2})?(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+')"
_PY_BREAK = r"(?:[ \t\f]*+(?:#[^\n]*+)?\n)++"
PYTHON_PATTERN = re.compile(
    "|".join(
        [
            _CONFLICT,
            # blanks before what isn't the end of a line, and words that are no prefix of a string: most of a text
            r"[ \t\f]*+[^\W\d]\w*+(?![\"'])(?:\.[^\W\d]\w*+)*+",
            r"[ \t\f]++(?=[^\s#\\])",
            rf"{_PY_BREAK}[ \t]*+(?:match|case)(?=[ \t]+[^=\s:.,)\]]|[ \t]*[(\[{{])(?=[^\n]*:[ \t]*(?:#[^\n]*)?\n)",
            rf"{_PY_BREAK}[ \t]*+case(?=[ \t]*\n?\Z)",
            rf"{_PY_BREAK}[ \t]*+type(?=[ \t]+\w+[ \t]*(?:\[[^\n]*\])?[ \t]*=[^=])",
            rf"{_PY_BREAK}[ \t]*+",
            r"#[^\n]*+|\\\n",
            _PY_STRING,
            r"[^\W\d]\w*+(?:\.[^\W\d]\w*+)*+|(?<=[)\]}\"'])\.[^\W\d]\w*+(?:\.[^\W\d]\w*+)*+",
            r"0[xXbBoO][\da-fA-F_]++|(?:0[0_]*+|[1-9][\d_]*+)(?:\.[\d_]*+)?(?:[eE][+-]?\d++)?j?(?!\w)|\.\d[\d_]*+(?:[eE][+-]?\d++)?j?",
            r"\.\.\.|->|:=|(?:\*\*|//|>>|<<|[-+*/%&|^@])=|==|!=|<=|>=|\*\*|//|>>|<<|[^\s]",
        ]
    ),
    re.M,
)


class Classes(dict):
    """Token classes of one language by the token's text; short texts are remembered."""

    REMEMBERED = 200_000

    def __init__(self, language: str):
        super().__init__()
        self.language = language
        words = PY_WORDS if language == PYTHON else JS_WORDS
        self.words = {word: code for code, group in words.items() for word in group.split()}
        if language in (TS, TSX):
            del self.words["void"]

    def __missing__(self, token: str) -> str:
        code = self.python_class(token) if self.language == PYTHON else self.script_class(token)
        if len(token) < 40 and len(self) < self.REMEMBERED:
            self[token] = code
        return code

    def expressions(self, pattern: re.Pattern[str], text: str) -> str:
        """What stands in the simple braces of a template or a tag, each in parentheses."""
        lexer = _lexer(self.language)[0]
        return "".join("(" + "".join([self[t] for t in lexer.findall("(" + m[1])[1:]]) + ")" for m in pattern.finditer(text) if m[1] is not None)

    def elements(self, text: str) -> str:
        """The tags of a text; one that goes on ends with A."""
        found = []
        for m in _ELEMENT.finditer(text):
            tag = m[0]
            if tag[1:2] == "/":
                found.append("L")
                continue
            inner = self.expressions(_IN_BRACES, tag) if "{" in tag else ""
            kind = "A" if tag[-1] != ">" else "Q" if tag[-2] == "/" else "J"
            found.append(f"A{inner}{'' if kind == 'A' else kind}" if inner else kind)
        return "".join(found)

    def python_class(self, token: str) -> str:
        bare = token.strip(" \t\f")
        if not bare:
            return ""
        if bare != token and (bare[0].isalpha() or bare[0] == "_"):
            return self.words.get(bare, "I")
        if "\n" in bare and bare[0] in "\n#":
            tail = token[token.rindex("\n") + 1 :].replace("\t", "        ")
            indent = len(tail) - len(tail.lstrip(" "))
            return "\n" + " " * indent + {"": "", "type": "t"}.get(tail.strip(), "i")
        if token[0] == "#" or token == "\\\n":
            return ""
        if len(token) > 1 and token[-1] in "\"'":
            return "S"
        first = token[0]
        if first == "." and len(token) > 1 and token != "...":
            return ".I" if token[1] not in "0123456789" else "N"
        if first.isalpha() or first == "_":
            return self.words.get(token, "I")
        if first.isdigit():
            return "N" if re.fullmatch(PYTHON_PATTERN, token) else "§"
        if re.match(_CONFLICT, token):
            return "§"
        if token.endswith("=") and token not in ("==", "!=", "<=", ">="):
            return "=" if token == "=" else "B" if token == ":=" else "m"
        return {"...": "I", "->": "B", "-": "u", "+": "u", "~": "u", "*": "*", "@": "@", "**": "B"}.get(token, token if token in "()[]{},:;." else "B" if token in ("==", "!=", "<=", ">=", "//", ">>", "<<", "/", "%", "&", "|", "^", "<", ">") else "§")

    def script_class(self, token: str) -> str:
        bare = token.strip()
        if not bare:
            return "\n" if "\n" in token else ""
        first = bare[0]
        if re.match(_CONFLICT, bare) and len(bare) >= 7:
            return "§"
        if bare.startswith(("//", "/*", "#!")):
            return "\n" if "\n" in bare else ""
        if len(bare) > 1:
            if first in "\"'" and bare[-1] == first:
                return "S"
            if first == "`":
                inner = self.expressions(_IN_TEMPLATE, bare)
                return f"T{inner}(" if bare[-1] == "{" else f"T{inner}T" if inner else "T"
            if first == "/" and bare != "/=":
                return "R"
            if ">" in bare and (first == "<" or self.language in (JSX, TSX) and "</" in bare and first not in "\"'`/"):
                return self.elements(bare)
            if bare[-1] == "{" and self.language in (JSX, TSX):
                return self.elements(bare) + "("
        if first.isdigit() or first == "." and len(bare) > 1 and bare[1].isdigit():
            return "§" if re.match(r"0\d", bare) else "N"
        if first.isalpha() or first in "_$#" and len(bare) > 1 or first == "$":
            if token != bare and token[-1] in " \t\n\r":
                if bare in ("of", "as", "satisfies", "is"):
                    return "o"
                if bare in ("keyof", "infer", "unique", "asserts"):
                    return "t"
                return {"from": "f", "type": "y", "interface": "y", "namespace": "y", "module": "y"}.get(bare, "a" if bare in TS_MODIFIERS.split() else "I")
            if bare.startswith("void") and bare.endswith("0"):
                return "N"
            return "I" if token != bare else self.words.get(bare, "I")
        if first in ".?" and len(bare) > 1 and bare.lstrip("?.\n\t ")[:1].isidentifier() or bare == "?." or first in ".?" and bare.lstrip("?. \n\t")[:1] in ("#", "$") and len(bare) > 1:
            return ""
        if len(bare) > 3 and first not in "=!<>*&|?+-.":
            return ""  # text between elements
        fixed = {"...": "d", "=>": "w", "++": "p", "--": "p", "+": "u", "-": "u", "~": "!", "!": "!", "=": "=", "<": "<", ">": ">", "==": "B", "===": "B", "!=": "B", "!==": "B", "<=": "B", "**": "B", "&&": "B", "||": "B", "??": "B", "<<": "B", "*": "B", "/": "B", "%": "B", "&": "B", "|": "B", "^": "B"}
        if bare in fixed:
            return fixed[bare]
        if bare.endswith("=") and len(bare) > 1:
            return "="
        return bare if bare in "()[]{},:;.?@" else "§"


@lru_cache(maxsize=8)
def _lexer(language: str) -> tuple[re.Pattern[str], Classes]:
    return (PYTHON_PATTERN if language == PYTHON else _script_pattern(language)), Classes(language)


_DROPS = re.compile(r"(?<=[^INSTR)\]LQ}prb!>])\n+|\n+(?=[=wB?:,;)\]}o.gle]|\Z)|\A\n+")
_ARGUMENTS = re.compile(r"(?<=I)<[^<>;{}]*+>(?=[(){}\[\],;=B&>:?\n.]|\Z)")


def _until(pattern: re.Pattern[str], instead: str, text: str) -> str:
    while True:
        shorter = pattern.sub(instead, text)
        if shorter == text:
            return text
        text = shorter


def script_tokens(content: str, language: str) -> list[str]:
    """The token classes of a script one after the other.

    What stands in braces in a template or an attribute is lexed like other code, to any depth: the
    brace that closes it is known by the number of those opened within.
    """
    pattern, classes = _lexer(language)
    plain = pattern.findall(content)
    if "${" not in content and language not in (JSX, TSX) or not any(token[-1] == "{" and len(token) > 1 for token in plain):
        return list(map(classes.__getitem__, plain))
    found: list[str] = []
    within: list[list] = []
    at = 0
    while at >= 0:
        begin, at = at, -1
        for m in pattern.finditer(content, begin):
            token = m[0]
            if token == "}" and within and not within[-1][0]:
                rest = within[-1][1].match(content, m.end())
                if rest is None:
                    found.append("§")
                    continue
                if within[-1][1] is _TEMPLATE_REST:
                    inner = classes.expressions(_IN_TEMPLATE, rest[1])
                    again = rest[2] != "`"
                    found.append(f"){inner}" + ("(" if again else "T"))
                else:
                    inner = classes.expressions(_IN_BRACES, rest[1])
                    again = bool(rest[2] or rest[5])
                    found.append(f"){inner}" + ("(" if rest[2] else ("Q" if rest[3] else "J") + classes.elements(rest[4]) + (classes.elements(rest[5]) + "(" if rest[5] else "")))
                if not again:
                    within.pop()
                at = rest.end()
                break
            found.append(classes[token])
            if token[-1] == "{":
                if len(token) > 1:
                    within.append([0, _TEMPLATE_REST if token[-2] == "$" else _TAG_REST])
                elif within:
                    within[-1][0] += 1
            elif token == "}" and within:
                within[-1][0] -= 1
    return found


_PY_LINE = re.compile(r"(\n *[it]?)")


def python_tokens(content: str) -> list[str]:
    """The token classes of a Python text; a line that is indented more or less than the one before begins with « or »."""
    pattern, classes = _lexer(PYTHON)
    _, *lines = _PY_LINE.split("".join(map(classes.__getitem__, pattern.findall("\n" + content + "\n"))))
    found: list[str] = []
    levels, depth = [0], 0
    for head, text in zip(lines[::2], lines[1::2]):
        # a word that is reserved only where a statement begins
        soft = head[-1].strip()
        if depth:
            found.append("I" if soft else "")
        else:
            indent = len(head) - 1 - len(soft)
            if not found:
                found.append("§" if indent else "")
            elif indent > levels[-1]:
                levels.append(indent)
                found.append("«")
            else:
                found.append("n")
                while levels[-1] > indent:
                    levels.pop()
                    found.append("»")
                if levels[-1] != indent:
                    found.append("§")
            found.append(soft)
        found.append(text)
        depth += text.count("(") + text.count("[") + text.count("{") - text.count(")") - text.count("]") - text.count("}")
        depth = max(depth, 0)
    found.extend("»" * (len(levels) - 1))
    return found


def token_classes(content: str, language: str) -> str:
    """The token classes of a text. In scripts a line break is kept, as n, only where it may end a statement."""
    content = content.removeprefix("\ufeff")
    if language == PYTHON:
        return "".join(python_tokens(content))
    text = "".join(script_tokens(content, language))
    if language in (TS, TSX):
        text = _until(_ARGUMENTS, "", text)
    return re.sub("\n+", "n", _DROPS.sub("", text))


def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file_id, language, pairs, classes) of rows (file_id, language, content)."""
    for batch in batches:
        every = [token_classes(content.replace("\r\n", "\n").replace("\r", "\n"), language) for content, language in zip(batch["content"], batch["language"])]
        pairs = [[a + b for a, b in set(zip("^" + classes, classes + "$"))] for classes in every]
        yield pd.DataFrame({"file_id": batch["file_id"], "language": batch["language"], "pairs": pairs, "classes": every})


ENDS = "INSTR)]LQ"
STARTS = "INSTR([{FKtu!paMJQA<"
STATEMENTS = STARTS + "XCVihqezbrkDy@;"
GOES_ON = "=wBup<>?:,;)]}o.([Tn$fEeglh"


def _pairs(rules: dict[str, str]) -> set[str]:
    return {a + b for left, right in rules.items() for a in left for b in right}


def script_pairs(language: str) -> set[str]:
    """Pairs of token classes that may stand side by side in a script language.

    Derived from what may end an expression, begin one, begin a statement, or continue one; a
    line break that may end a statement is the class n, the ends of the text are ^ and $.
    """
    typed = language in (TS, TSX)
    pairs = _pairs(
        {
            "^n;": STATEMENTS + "}$n);.",
            "{": STATEMENTS + "}dBa#,",
            "}": STATEMENTS + GOES_ON + "JLQA",
            ENDS: GOES_ON,
            "IS": "{",
            ")": STATEMENTS + "JQ",
            "b": "I;n}$e",
            "(": STARTS + ")d,CV;ak@",
            "[": STARTS + "],da",
            ",": STARTS + "d)]}nDa",
            "=BuwtkDo?:!<>d": STARTS + "a",
            "u": "n",
            "w": "r" if typed else "",
            ":": STATEMENTS + "}nD",
            "p": GOES_ON,
            "F": "I(B",
            "FraMX,{k;n}": "B",
            "B": "oI",
            "K": "IE{a",
            "E": "I(FK{S",
            "ig": "({t",
            "h": "(",
            "qelz": "{",
            "ez": STATEMENTS,
            "r": STARTS + ";n}$)a",
            "C": "I{[K",
            "V": "I{[(",
            "M": "IS{(By",
            "X": "CVFKD{BayI@M",
            "D": ":FKao}(,",
            "f": "S",
            "a": "IFK[{SNa#yCV(",
            "y": "I{S",
            "@": "I(",
            "#": "I",
            "o": "C",
            "JLQ": "JLQA{",
            "LQ": GOES_ON,
            "A": "(",
        }
    )
    if typed:
        pairs |= _pairs({"?": ":),=;(.]", "!": GOES_ON, ENDS + "}": "!", ">": GOES_ON + "{I", "=:(,|<B?": "Bt<y", "L": "", "I": "y", "}": "y", ":": "B"})
    return pairs


def python_pairs() -> set[str]:
    """The same for Python; n is the end of a logical line, « and » begin one that is indented more or less."""
    starts = "INS([{lu!trBa*"
    statements = starts + "DKieqgrtMfb@$a"
    goes_on = "=mBu:,;)]}o.([n$ie!*"
    return _pairs(
        {
            "^n»": statements + ";»",
            "«": statements + ";",
            ":": starts + "DKieqgrtMfb])}=,;B«",
            "INS)]}": goes_on + "a",
            "S": "S",
            "IN": "M",
            "([{": starts + ")]}:,B*",
            ",": starts + ")]}nf:*B=",
            "=mBu!oit": starts + "(",
            "*": starts + ",)",
            "B": ",):",
            ";": starts + "rtMfbn$",
            "i": starts,
            "eq": ":" + starts,
            "g": ":B" + starts,
            "l": ":I*B,",
            "r": starts + "nf;)",
            "t": starts,
            "b": "n;$",
            "D": "I",
            "K": "I",
            "M": "I(B*",
            "f": "I.M" + starts,
            "a": "Di",
            "@": "I(",
            "o": "!",
            "!": "o",
            ".": "IM.",
            "]": "I",
        }
    )


def permitted(spark: SparkSession) -> DataFrame:
    """(language, pair): a few thousand rows fixed by the grammars."""
    rows = [(language, pair) for language in (JS, JSX, TS, TSX) for pair in script_pairs(language)]
    return spark.createDataFrame(rows + [(PYTHON, pair) for pair in python_pairs()], "language string, pair string")


def lexed(files: DataFrame) -> DataFrame:
    """(file_id, language, pairs, classes) of the files with content; a redelivered file may repeat."""
    rows = files.where("file_id is not null and content is not null and content != ''").select("file_id", language_of().alias("language"), "content")
    rows = rows.where(F.col("language").isin(PYTHON, JS, JSX, TS, TSX))
    ship(files.sparkSession)
    return rows.mapInPandas(lex, "file_id long, language string, pairs array<string>, classes string")


def language_of() -> Column:
    """The row's language, or where that is null the one of its path's extension."""
    extension = F.lower(F.regexp_extract(F.coalesce("path", "relative_path"), r"\.([^./\\]+)$", 1))
    return F.coalesce(F.lower("language"), *[F.when(extension == e, name) for e, name in EXTENSIONS.items()])


def bad_pairs(tokens: DataFrame) -> DataFrame:
    """(file_id, language) with two adjacent tokens that the grammar doesn't permit side by side."""
    rows = tokens.select("file_id", "language", F.explode("pairs").alias("pair"))
    return rows.join(F.broadcast(permitted(tokens.sparkSession)), ["language", "pair"], "left_anti").select("file_id", "language")


OPENS, CLOSES = "([{J«", ")]}L»"
_EACH = rf"[{re.escape(OPENS + CLOSES)}]?[^{re.escape(OPENS + CLOSES)}]*"
#: What a pair of brackets is to the statement around it.
SCRIPT_REDUCED, PYTHON_REDUCED = {")": "P", "]": "Y", "}": "G", "L": "Q"}, {")": "P", "]": "Y", "}": "Y", "»": "G"}
#: Languages whose statements are judged alike.
FAMILY_PYTHON, FAMILY_UNTYPED, FAMILY_TYPED = 0, 1, 2


def _family() -> Column:
    return F.when(F.col("language") == PYTHON, FAMILY_PYTHON).when(F.col("language").isin(TS, TSX), FAMILY_TYPED).otherwise(FAMILY_UNTYPED).cast("tinyint")


def bracket_rows(tokens: DataFrame) -> DataFrame:
    """(file_id, family, place, kind, text, wrong, opener) of each bracket with the tokens up to the next one.

    `kind` is the place of the bracket in `OPENS` from 1, negative for one that closes, 0 for the
    beginning of the text. A running sum gives each bracket its depth. `opener` says in which
    bracket the tokens lie: the last that was opened at their depth, as 8 * place + kind; null
    outside of all. A row is `wrong` if the next bracket closes another kind than the one it lies
    in, or if the text ends within one.
    """
    # a redelivered file has one row again; its rows lie together from here on
    once = tokens.groupBy("file_id").agg(F.min(_family()).alias("family"), F.min("classes").alias("classes"))
    pieces = F.concat(F.array(F.lit("")), F.filter(F.regexp_extract_all("classes", F.lit(_EACH), F.lit(0)), lambda piece: piece != ""))
    first = lambda: F.substring("piece", 1, 1)
    rows = once.select("file_id", "family", F.posexplode(pieces).alias("place", "piece"))
    kind = F.when(F.col("piece") == "", 0).otherwise(F.instr(F.lit(OPENS), first()) - F.instr(F.lit(CLOSES), first())).cast("tinyint")
    rows = rows.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 2)"))).drop("piece")
    step = F.signum("kind").cast("int")
    along = Window.partitionBy("file_id").orderBy("place")
    rows = rows.withColumns({"depth": F.sum(step).over(along).cast("int"), "next": F.lead("kind").over(along)})
    opener = F.last(F.when(F.col("kind") > 0, F.col("place").cast("long") * 8 + F.col("kind")), ignorenulls=True).over(Window.partitionBy("file_id", "depth").orderBy("place"))
    rows = rows.withColumn("opener", F.when(F.col("depth") > 0, opener))
    inside = F.coalesce(F.col("opener") % 8, F.lit(0))
    wrong = F.when(F.col("next").isNull(), F.col("depth") != 0).when(F.col("next") < 0, inside != -F.col("next")).otherwise(False)
    return rows.withColumn("wrong", wrong).drop("depth", "next")


#: Statements that no production of a script language makes; the untyped and typed languages add their own.
SCRIPT_WRONG = (
    r"qG(?![gl])|q(?![G{])|CI(?![=:o!])|FB?I?(?![PI(])|FB?I?P$|i(?!P|tP|\()|h(?!P|\()|g(?!P|[G{(])|l(?![G{])|K(?!I?(?:E[IPBNSY,.<>|]*+)*+[G{])|(?<![.IP])iP$|[CV][GY]$|^k[^:]*$|yI(?:E[^G]*)?$"
    r"|^M(?!S|P|\(|\.|y?(?:I(?:,(?:G|BoI))?|G|BoI)fS|y?I=)|fI|^\{:$|^!$"
)
UNTYPED_WRONG = r"CI:|VI:|^\(I\??:|P:I(?:Y|<[^>]*>)*[G{]|FB?I?P(?![G{])|I\?:"
TYPED_WRONG = r"FB?I?P(?![G{:B])"
#: The same for clauses of Python that belong together, each with the end of its line or its block: a try without a handler, a handler or else of nothing
#: or of a definition, a header without a colon, a condition without its else, something assigned to a call or a literal.
PYTHON_WRONG = (
    r"^!$|q:(?:G|[^nG]*n)(?![ge])|^[ge]|^[^:]*n[ge]|^a?[DK][^nG]*:(?:G|[^nG]*n)[ge]|(?:^|[nG])a?[DKiqeg](?![^nG]*:)|^[^:]*[^:a;n]i[^:ien]*+n?$"
    r"|(?:^|;)[^:;nGl]*[IPY]P[=m]|(?:^|;)[NS][=m]|(?:^|;)Ym"
)


def statements(rows: DataFrame) -> DataFrame:
    """(file_id, family, statement) of `bracket_rows`, each pair of brackets within reduced to one token.

    The tokens of a block are those that lie in it, in order. Statements end at ; and line breaks, in
    Python clauses that go on stay together. A wrong bracket is the statement `!`, a parenthesis that
    opens with an annotation `(I:`.
    """
    python = F.col("family") == FAMILY_PYTHON
    names = lambda table: F.array(*[F.lit(table.get(c, "")) for c in CLOSES])
    symbol = F.when(F.col("kind") < 0, F.element_at(F.when(python, names(PYTHON_REDUCED)).otherwise(names(SCRIPT_REDUCED)), -F.col("kind").cast("int"))).otherwise("")
    number = lambda *marks: [OPENS.index(mark) + 1 for mark in marks]
    inside = F.coalesce(F.col("opener") % 8, F.lit(0))
    block = F.when(python, inside.isin(0, *number("«"))).otherwise(inside.isin(0, *number("{")))
    opened = (F.col("kind") == number("(")[0]) & ~python & F.col("text").rlike(r"^I\??:")
    kept = rows.where(F.col("wrong") | block | opened)
    marks = F.when(F.col("wrong"), "!").when(opened, F.concat(F.lit("("), F.regexp_extract("text", r"^(I\??:)", 1)))
    grouped = kept.groupBy("file_id", "family", "opener").agg(F.collect_set(marks).alias("marks"), F.collect_list(F.when(block, F.struct("place", F.concat(symbol, "text").alias("piece")))).alias("pieces"))
    whole = F.array_join(F.transform(F.array_sort("pieces"), lambda x: x["piece"]), "")
    parts = grouped.select("file_id", "family", "marks", whole.alias("whole"))
    split = F.when(python, F.split("whole", r"(?<=[nG])(?![ge])")).otherwise(F.split("whole", "[;n]"))
    return parts.select("file_id", "family", F.explode(F.array_distinct(F.concat("marks", split))).alias("statement"))


def bad_statements(tokens: DataFrame) -> DataFrame:
    """(file_id) with brackets that don't nest or a statement that no production makes.

    Statements recur, so each distinct one is judged once; the files that hold a wrong one are
    found by a join on the statement.
    """
    literal = tokens.where((F.col("language") != PYTHON) & F.col("classes").rlike(r"^n?\{[SN]:")).select("file_id", _family().alias("family"), F.lit("{:").alias("statement"))
    rows = cut(statements(bracket_rows(tokens)).unionByName(literal))
    kinds = rows.select("family", "statement").distinct()
    statement = F.col("statement")
    typed = F.when(F.col("family") == FAMILY_TYPED, statement.rlike(TYPED_WRONG)).otherwise(statement.rlike(UNTYPED_WRONG))
    wrong = kinds.where(F.when(F.col("family") == FAMILY_PYTHON, statement.rlike(PYTHON_WRONG)).otherwise(statement.rlike(SCRIPT_WRONG) | typed))
    return rows.join(wrong, ["family", "statement"], "left_semi").select("file_id")


def invalid_files(files: DataFrame) -> DataFrame:
    """Distinct file_ids whose content is not valid by the grammar of their language.

    The language is the row's, or where that is null its path's extension; other languages, null or
    empty content and a null file_id are no case. A redelivered file counts once. Only syntax
    counts. Without rows there are none. A text of any length is lexed where it lies; of a long text
    only its brackets, with the tokens between them, form a group.
    """
    tokens = cut(lexed(files))
    return bad_pairs(tokens).select("file_id").unionByName(bad_statements(tokens)).distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """(project_name, language, files, invalid, rate) over the files with content."""
    known = files.where("file_id is not null and content is not null and content != ''").select("file_id", "project_name", language_of().alias("language")).dropDuplicates(["file_id"])
    flagged = known.join(invalid_files(files).withColumn("bad", F.lit(1)), "file_id", "left")
    rates = flagged.groupBy("project_name", "language").agg(F.count("*").alias("files"), F.count("bad").alias("invalid"))
    return rates.withColumn("rate", F.col("invalid") / F.col("files"))
