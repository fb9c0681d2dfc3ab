"""Functions paired with their documentation.

Recursive patterns capture comment, signature and balanced body of each function together, with
strings, comments and regular expressions protected: from its file, or where that doesn't hold the
record's docstring, from docstring and code of the record. Documentation that says nothing beyond the signature is filtered out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship

SCRIPT_FUNCTION = regex.compile(
    r"""
    (?(DEFINE)
      (?P<string>"(?:[^"\\\n]++|\\.)*+" | '(?:[^'\\\n]++|\\.)*+' | `(?:[^`\\$]++|\\.|\$(?!\{)|\$(?&braces))*+`)
      (?P<remark>//[^\n]*+ | /\*(?:[^*]++|\*(?!/))*+\*/)
      (?P<pattern>(?<=[=(,:;!&|?\[{}]\s*+)/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*+)
      (?P<attributes>(?:\s++[\w:-]++(?:=(?:"[^"]*+"|'[^']*+'|(?&braces)))?+|\s*+(?&braces))*+\s*+)
      (?P<element><(?:[A-Za-z][\w.:-]*+)?(?&attributes)(?:/>|>(?:[^<{]++|(?&braces)|(?&element))*+</[\w.:-]*+\s*+>))
      (?P<inner>[^][(){}"'`/<]++|(?&braces)|(?&round)|(?&square)|(?&string)|(?=/)(?:(?&remark)|(?&pattern)|/)|(?=<)(?:(?<=(?:[=(,:;!&|?\[{}>]|\breturn)\s*)(?&element)|<))
      (?P<braces>\{(?&inner)*+\})
      (?P<round>\((?&inner)*+\))
      (?P<square>\[(?&inner)*+\])
      (?P<angle><(?:[^<>(){}\[\]]|=>|(?&round)|(?&square)|(?&braces)|(?&angle))*+>)
      (?P<type>(?:[^\n{}()\[\]<>;="'`]|(?&string)|(?&round)(?:\s*+=>)?+|(?&square)|(?&angle)|(?&braces)(?=\s*+(?:\{|=>|[|&\[])))++)
    )
    (?P<comment>/\*\*(?:[^*]++|\*(?!/))*+\*/)[ \t]*\r?\n[ \t]*
    (?P<code>
      (?P<signature>(?:(?:export|default|declare|public|private|protected|static|override|abstract|readonly|async|get|set|function|const|let|var)\b\*?\s*|\*\s*|@[\w.]+(?&round)?\s*)*+
        [\w$\#]++ (?:[^\n({=;]|(?&square)|(?&angle))*? (?: =\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*)?\s* )? (?:(?&angle)\s*)? (?:(?&round)|[\w$]+(?=\s*=>)) (?:\s*+:\s*+(?&type))?)
      (?:\s*+(?:=>\s*+)?(?P<body>(?&braces)) | \s*+=>\s*+(?P<expression>(?:(?&string)|(?&round)|(?&square)|(?&braces)|[^\n;(){}\[\]"'`])++) | (?=\s*+(?:;|\n|\Z)))(?:[ \t]*+;)?+
    )
    """,
    regex.X | regex.S,
)
PYTHON_FUNCTION = regex.compile(
    r"""
    (?(DEFINE)
      (?P<long>\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3} | '{3}(?:[^'\\]++|\\.|'(?!''))*+'{3})
      (?P<string>(?&long) | "(?:[^"\\\n]++|\\.)*+" | '(?:[^'\\\n]++|\\.)*+')
      (?P<inner>[^][(){}"'\#]++|(?&string)|\#[^\n]*+|(?&brackets))
      (?P<brackets>\((?&inner)*+\)|\[(?&inner)*+\]|\{(?&inner)*+\})
      (?P<rest>(?:[^][(){}"'\#\\\n]++|(?&string)|(?&brackets)|\#[^\n]*+|\\\r?\n|[^\n])*+)
    )
    (?P<indent>[ \t]*+)
    (?P<code>
      (?P<signature>(?:@(?&rest)\n[ \t]*+)*+ (?:async\s++)?def\s++\w++\s*(?:\[[^\n(]*\]\s*)?(?&brackets)\s*(?:->(?:(?&string)|(?&brackets)|[^:\n"'])*+)?)
      :[ \t]*+(?:\#[^\n]*+)?+\s*+(?:\#[^\n]*+\s*+)*+
      (?P<comment>[rRuU]?(?&string))(?=[ \t]*+(?:\r?\n|;|\#|\Z))
      (?P<body>(?&rest)(?:\n(?:[ \t]*+(?:\#[^\n]*+)?\r?+(?=\n|\Z) | (?P=indent)[ \t]++(?&rest)))*+)
    )
    """,
    regex.X | regex.S,
)

#: Words that carry nothing of substance beside the words of a signature.
FILLERS = (
    "a an the of to in for and or this that it is self cls function method class module def todo fixme xxx tbd tba wip hack na n no none missing later here "
    "me my add write fill doc docs docstring document documented documentation undocumented describe description summary comment comments "
    "param params parameter parameters arg args argument arguments return returns yield yields raise raises throw throws type types rtype placeholder "
    "example stub generated see above below code name untitled pending async await static const let var export default private public protected readonly "
    "string number boolean object void any unknown null undefined str int float bool list dict tuple set optional value values"
).split()


def function_at(content: str, begin: int, python: bool) -> tuple[str, str] | None:
    """(comment, code) of the function whose definition starts in the line at `begin`; None unless one match gives comment, signature and body.

    A declaration without a body, as of an interface, ends with its line.
    """
    if python:
        found = PYTHON_FUNCTION.match(content, begin)
        if not found:
            return None
        return regex.sub(r"^[rRuU]?(\"{3}|'{3}|[\"'])|(\"{3}|'{3}|[\"'])$", "", found["comment"]), found["code"].rstrip()
    opens = content.rfind("/**", 0, begin)
    ends = content.find("*/", opens + 3, begin) if opens >= 0 else -1
    # the comment ends on the line above
    if ends < 0 or content[ends + 2 : begin].strip() or content.count("\n", ends, begin) != 1:
        return None
    found = SCRIPT_FUNCTION.match(content, opens)
    if not found:
        return None
    return regex.sub(r"(?m)^[ \t]*\*(?!/)[ \t]?", "", found["comment"][3:-2]), found["code"]


def _from_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, found = [], []
        for content, python, wanted in zip(batch["content"], batch["python"], batch["wanted"]):
            begins = [0, *(m.end() for m in regex.finditer("\n", content))]
            for item in wanted:
                line = item["start_line"]
                if line is not None and 1 <= line <= len(begins):
                    pair = function_at(content, begins[line - 1], bool(python))
                    if pair is not None:
                        ids.append(item["entity_id"])
                        found.append(pair)
        yield pd.DataFrame({"entity_id": pd.Series(ids, dtype="int64"), "comment": pd.Series([c for c, _ in found], dtype="object"), "captured": pd.Series([c for _, c in found], dtype="object")})


def _is_python(path: str) -> Column:
    """Whether a path is a python file's."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("py", "pyi")


def functions_from_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(entity_id, comment, captured) for rows (entity_id, project_name, file_path, start_line) whose file gives comment, signature and body.

    The entities of a file travel to it as one list, so each text moves once.
    """
    ship(files.sparkSession)
    lists = wanted.groupBy("project_name", "file_path").agg(F.collect_set(F.struct("entity_id", "start_line")).alias("wanted"))
    texts = files.where("content is not null and content != ''").select(
        "project_name", F.col("path").alias("file_path"), "content", _is_python("path").alias("python")
    )
    rows = texts.join(lists, ["project_name", "file_path"]).select("content", "python", "wanted")
    return rows.mapInPandas(_from_files, "entity_id long, comment string, captured string").dropDuplicates(["entity_id"])


def _stems(text: Column) -> Column:
    """Distinct word stems of a text; humps and underscores part words."""
    text = F.lower(F.regexp_replace(F.regexp_replace(text, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2"), "_", " "))
    for _ in range(2):
        for ending, instead in ((r"(?<=\p{L}{2}[^\W_s])s\b", ""), (r"(?<=\p{L}{3})(?:ing|ed)\b", ""), (r"(?<=\p{L}{2})(?:ie|y|e|i)\b", ""), (r"(\p{L})\1\b", "$1")):
            text = F.regexp_replace(text, ending, instead)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def says_something(doc: Column, name: Column, owner: Column, signature: Column) -> Column:
    """Whether a comment has a word beyond fillers and the words of name, owner and signature. Null says nothing."""
    known = F.array_union(_stems(F.concat_ws(" ", name, owner, signature)), _stems(F.lit(" ".join(FILLERS))))
    return F.coalesce(F.size(F.array_except(_stems(doc), known)) > 0, F.lit(False))


def _same_text(a: Column, b: Column) -> Column:
    """Whether two texts differ in nothing but white space; null is the same as none."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def record_function(docstring: str, code: str, python: bool) -> str | None:
    """The code of a record, from signature to body, by the match of a text made of its docstring and code; None without a match.

    A script's docstring becomes the comment above the code. Python's code holds its own.
    """
    if python:
        found = function_at(code, 0, True)
    else:
        comment = f"/** {docstring.replace('*/', '* /')} */\n"
        found = function_at(comment + code, len(comment), False)
    return found[1] if found else None


def _captured_of_records(docstring: Column, code: Column, python: Column) -> Column:
    """`record_function` of columns; null where the code is null."""

    @F.pandas_udf("string")
    def captured(docstrings: pd.Series, codes: pd.Series, pythons: pd.Series) -> pd.Series:
        return pd.Series([record_function(d, c, bool(p)) if d is not None and c is not None else None for d, c, p in zip(docstrings, codes, pythons)], dtype="object")

    return captured(docstring, code, python)


def function_pairs(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(entity_id, code, documentation) of the functions and methods with documentation of substance.

    * Every function is captured from its file in one match: the string that opens the body (python)
      or the /** */ comment that ends on the line above (others), signature and body. The
      documentation is `docstring`; where that is null or blank, the match's comment, and without a match there is no pair.
    * `code` is the match's. Where its comment isn't the docstring, as the file is missing, empty or
      another version, docstring and code of the record are matched, and what no pattern matches
      keeps the record's code.
    * Blank text, punctuation, marks for later, fillers and words of the name, class, parameters and
      their types are nothing of substance; one other word is enough.
    * Repeated rows count once, deleted ones count, without rows there are none.
    """
    functions = entities.where(F.col("type").isin("function", "method") & F.col("entity_id").isNotNull())
    head = F.regexp_extract("code", r"^(?:\s*@[^\n]*\n)*([^\n]*)", 1)
    own = F.regexp_replace("docstring", r"^\s+|\s+$", "")
    rows = functions.select(
        "entity_id", "project_name", "file_path", "start_line", "name", "code", "docstring",
        F.concat_ws(" ", F.regexp_extract("qualified_name", r"([^.]*)\.[^.]*$", 1), "parent_class").alias("owner"),
        F.concat_ws(" ", "signature", head).alias("heading"),
        (F.coalesce(own, F.lit("")) == "").alias("bare"),
    )
    says = lambda doc: says_something(F.col(doc), F.col("name"), F.col("owner"), F.col("heading"))
    captures = functions_from_files(rows.select("entity_id", "project_name", "file_path", "start_line"), files)
    told = rows.where(F.col("bare") | says("docstring")).join(captures, "entity_id", "left").where(~F.col("bare") | says("comment"))
    held = told.withColumn("held", F.col("bare") | _same_text(F.col("docstring"), F.col("comment")))
    rest = _captured_of_records(F.col("docstring"), F.when(~F.col("held"), F.col("code")), _is_python("file_path"))
    code = F.when(F.col("held"), F.col("captured")).otherwise(F.coalesce(rest, "code"))
    pairs = held.select("entity_id", code.alias("code"), F.when(F.col("bare"), F.col("comment")).otherwise(F.col("docstring")).alias("documentation"))
    return pairs.dropDuplicates(["entity_id"])
