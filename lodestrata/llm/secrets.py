"""Credentials in source code: found, located by line, and redacted in place.

Lines that could hold one are chosen by column expressions. Their literals are segmented into
dictionary words by Viterbi. A literal is a credential if the part that no word explains is long
enough for the name it is given to; placeholders are words, and fall out by that. Digests, ids and
look-ups in an environment or a vault are excluded by their form.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.tokens import TOKENIZERS, VOCABULARY, load_ranks
from lodestrata.session import ship

#: Prefixes and shapes that services give their credentials.
PROVIDERS = re.compile(
    r"(?<![A-Za-z0-9])(?:sk-ant-[\w-]{16,}|sk-(?:proj-|live-|test-|svcacct-)?[A-Za-z0-9]{20,}|[sr]k_(?:live|test)_\w{10,}|gh[oprsu]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{20,}"
    r"|xox[abeoprs]-[\w-]{10,}|xapp-[\w-]{10,}|A(?:KIA|SIA)[A-Z0-9]{16}|hf_[A-Za-z0-9]{20,}|whsec_[\w+/=]{16,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|pypi-[\w-]{20,}"
    r"|dckr_pat_[\w-]{16,}|shp(?:at|ss|ca)_[a-fA-F0-9]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL_LOGIN = re.compile(r"://[^/\s:@\"'`]*:([^/\s@\"'`]+)@[\w.\[$-]")
IN_TEXT = re.compile(
    r"(?i)[?&;](?:[\w-]*(?:token|key|secret|password|passwd|pwd|auth|sig|signature|credential|code))=([^&\s\"'`]+)"
    r"|\s(?:-u|--user)[ =]\w[\w.-]*:(\S+)|--(?:[\w-]*(?:password|passwd|token|secret|key|pass))[ =]+([^\s\"'`]+)|\s-p\s?(\S{6,})"
    r"|(?:Authorization|X-[\w-]*(?:Key|Token|Secret|Auth)[\w-]*)[\"']?\s*[:=,]\s*[\"']?(?:(?:Bearer|Basic|Token|ApiKey)\s+)?([^\s\"'`]{8,})"
    r"|\b(?:Bearer|Basic)\s+([A-Za-z0-9+/_.=~-]{8,})"
)
#: A literal may be cut off by the end of the text.
LITERAL = re.compile(r"\"((?:[^\"\\]|\\.)*)(?:\"|$)|'((?:[^'\\]|\\.)*)(?:'|$)|`([^`]*)(?:`|$)")
ASSIGNED = re.compile(r"([A-Za-z_$][\w$.-]*)[\"'\])]*\s*(?:\??:\s*[\w<>\[\]|. ]+?)?\s*(?:===?|!==?|:=|\+=|[=:]|\|\||\?\?)\s*\(?\s*(?:[rRbBuUfF]{1,2})?$")
DEFAULTED = re.compile(r"(?:getenv|environ\.get|\benv|\bget|config|setting\w*|default|fallback)\w*\(\s*[\"']([\w.-]+)[\"']\s*,\s*(?:[rbuf])?$", re.I)
FROM_ENV = re.compile(r"\benv(?:iron)?(?:\.(\w+)|\[[\"'](\w+)[\"']\])\s*(?:\|\||\?\?|\bor\b)\s*(?:[rbuf])?$")
REMARK = re.compile(r"(?:^|\s)(?:#|//|/?\*)\s?(.*)$")

#: The words of a name that make it sensitive, and those that make it a name of something else.
PASSWORD_WORDS = frozenset("password passwd pwd pw pass passphrase passcode pin pws passwords supplied kennwort passwort kennwoerter contrasena contraseña motdepasse mdp senha clave geheim".split())
SECRET_WORDS = PASSWORD_WORDS | frozenset("secret secrets token tokens apikey apikeys key keys credential credentials auth authorization bearer cookie jwt salt signature sig sas".split())
OTHER_ENDINGS = frozenset(
    "field fields column columns param params parameter name names header ref reference limit limits length len min max size sizes count ttl expiry expires path file filename dir "
    "url uri endpoint host type kind prefix suffix format pattern regex re label hint message msg error text title description help policy env var variable index id ids version "
    "class url endpoint placeholder store provider service manager rate bucket".split()
)
OTHER_WORDS = frozenset("public pub verify cert certificate hash sha sha1 sha256 sha512 md5 digest checksum etag integrity fingerprint revision commit build trace request regex html css icon image".split())
#: Which lines are looked at: all that `find_values` can find something on. These run in the JVM, where \\s and \\w are ASCII, so they are wider than those of the judge.
#: A word of a name stands in lower case, capitalized or in capitals, as `name_words` parts them.
NAMED = "|".join(
    f"{before}(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(sorted(words))})(?![a-z0-9])"
    for before, words in (("(?<![A-Za-z])", SECRET_WORDS), ("", {w.title() for w in SECRET_WORDS}), ("(?<![A-Z])", {w.upper() for w in SECRET_WORDS}))
)
QUOTED = r"(?s)[\"'`].{4,}"
UNNAMED = r"([\"'`])[A-Za-z0-9+/_=.~-]{20,}\1"
SHAPED = (
    r"(?s)-----BEGIN .*PRIVATE KEY|://[^/\s:@]*:[^/\s@]+@|sk-|[sr]k_(?:live|test)_|gh[oprsu]_|github_pat_|glpat-|npm_|xox[abeoprs]-|xapp-|AKIA|ASIA|hf_|whsec_|AIza|SG\.|pypi-|dckr_pat_|shp(?:at|ss|ca)_|eyJ"
    r"|(?i:[?&;][^=&;?]*(?:token|key|secret|password|passwd|pwd|auth|sig|signature|credential|code)=[^&\s\"'`]|\W(?:-u|--user)[ =][^\s:]+:\S|(?<!-)--[^\s=]*(?:password|passwd|token|secret|key|pass)[ =]+[^\s\"'`]|\W-p\W?\S{6}"
    r"|authorization\W|x-[^\s\"':=,]*(?:key|token|secret|auth)|(?:bearer|basic)\W+[A-Za-z0-9+/_.=~-]{8})"
)
REMARKED = r"(?i)passw|secret|token|api.?key|credential|\bpw\b|login|\bkey\b"
REMARK_START = r"(?:^|\W)(?:#|//|/?\*)"
#: Values that say where the secret is to be found, or are put together at run time.
REFERENCE = re.compile(r"^(?:env|vault|ssm|file|secretsmanager|aws-?sm|gcp|sops|op|keyring|kms|arn|https?|data|urn|path|config)[:/]|^\$|\$\{|\{\{|%\(|^\{[\w.]*\}|^os\.|^process\.|^%\w+%", re.I)
DIGEST = re.compile(r"^(?:[0-9a-f]{7,8}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:sha|md)\d+[-:].*)$", re.I)
PLAIN_TOKEN = re.compile(r"^[A-Za-z0-9+/_=.~-]+$")
#: How encoded pictures, archives and documents begin.
ENCODED = re.compile(r"^(?:iVBOR|/9j/|R0lGOD|UklGR|H4sI|UEsD|JVBER|AAAA|AGFz|d09G)")
#: A public vocabulary whose tokens tell whole words, beside the one of `tokens`.
WORD_VOCABULARY = "word_bpe_49k.json"


class Words:
    """Cheapest segmentation into dictionary words; a word costs the more the rarer it is.

    `ranks` gives each word its place by frequency. A word is one only in lower case, capitalized
    or in capitals; a run of one character is explained like a word.
    """

    UNKNOWN = 7.0
    LONGEST = 16

    def __init__(self, ranks: dict[str, int]):
        self.cost = {word: 2.0 + math.log(rank + 100) for word, rank in ranks.items()}

    def residual(self, text: str) -> str:
        """The letters and digits of `text` that no word explains, in order."""
        low = text.lower()
        if len(low) != len(text):
            text = low
        n = len(text)
        best, back = [0.0] * (n + 1), [1] * (n + 1)
        run = 0
        for end in range(1, n + 1):
            char = low[end - 1]
            run = run + 1 if end > 1 and low[end - 2] == char else 1
            best[end], back[end] = best[end - 1] + (self.UNKNOWN if char.isalnum() else 0.5), 1
            if run >= 4 and best[end - run] + 8.0 < best[end]:
                best[end], back[end] = best[end - run] + 8.0, run
            if char.isalpha():
                for size in range(3, min(self.LONGEST, end) + 1):
                    cost = self.cost.get(low[end - size : end])
                    if cost is not None and best[end - size] + cost < best[end]:
                        piece = text[end - size : end]
                        if piece.islower() or piece.isupper() or piece[1:].islower():
                            best[end], back[end] = best[end - size] + cost, size
        left, end = [], n
        while end > 0:
            if back[end] == 1 and low[end - 1].isalnum():
                left.append(low[end - 1])
            end -= back[end]
        return "".join(reversed(left))


def dictionary(folder: str) -> dict[str, int]:
    """Words by their place: the tokens of two public vocabularies that stand for whole words."""
    ranks: dict[str, int] = {}

    def put(word: str, rank: int) -> None:
        if word.isascii() and word.isalpha() and (len(word) >= 4 or len(word) == 3 and rank < 9000):
            ranks[word] = min(rank, ranks.get(word, rank))

    for token, rank in load_ranks(os.path.join(folder, VOCABULARY)).items():
        if token[:1] == b" ":
            put(token[1:].decode("utf-8", "ignore").lower(), rank)
    with open(os.path.join(folder, WORD_VOCABULARY), encoding="utf-8") as source:
        for token, rank in json.load(source)["model"]["vocab"].items():
            if token.endswith("</w>"):
                put(token[:-4].lower(), rank)
    return ranks


@lru_cache(maxsize=4)
def _words(folder: str) -> Words:
    return Words(dictionary(folder))


def name_words(name: str) -> list[str]:
    """The lower-case words of an identifier."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name)
    return [w.lower() for w in re.findall(r"[A-Za-z]+\d*", name.replace("_", " "))]


def name_kind(name: str) -> str:
    """`password`, `secret`, `other` (of something that isn't secret) or `neutral`."""
    words = name_words(name)
    if not words:
        return "neutral"
    if OTHER_WORDS.intersection(words) or words[-1] in OTHER_ENDINGS and SECRET_WORDS.intersection(words):
        return "other"
    if PASSWORD_WORDS.intersection(words):
        return "password"
    if words in (["key"], ["keys"]):
        return "neutral"
    return "secret" if SECRET_WORDS.intersection(words) else "neutral"


def is_secret(value: str, kind: str, words: Words) -> bool:
    """Whether a literal given to a name of `kind` is a credential: by what no word of it explains."""
    if kind == "other" or len(value) < 4 or " " in value.strip() or REFERENCE.search(value):
        return False
    unnamed = kind not in ("password", "secret")
    if unnamed and not (len(value) >= 20 and not DIGEST.match(value) and not ENCODED.match(value) and PLAIN_TOKEN.match(value)):
        return False
    left = words.residual(value)
    digits = sum(c.isdigit() for c in left)
    letters = len(left) - digits
    if unnamed:
        # without a name only a long residual of mixed characters tells
        return len(left) >= 0.6 * len(value) and digits >= 2 and letters >= 6 and any(c.isupper() for c in value) and any(c.islower() for c in value)
    if kind == "password":
        return len(value) >= 5 and (digits >= 1 or letters >= 4)
    return len(value) >= 8 and (digits >= 2 or digits and letters >= 3 or letters >= 6)


def find_values(line: str, words: Words) -> list[tuple[int, int]]:
    """Start and end of the secrets that begin on a line."""
    found: list[tuple[int, int]] = []
    for m in PRIVATE_KEY.finditer(line):
        found.append((m.start(), len(line.rstrip("\"'`;, \r"))))
    for m in PROVIDERS.finditer(line):
        if len(words.residual(m[0])) >= max(8, 0.4 * len(m[0])):
            found.append(m.span())
    for m in URL_LOGIN.finditer(line):
        if not re.search(r"[{}<>$*]", m[1]) and is_secret(m[1], "password", words):
            found.append(m.span(1))
    for m in IN_TEXT.finditer(line):
        group = next(i for i in range(1, 7) if m[i])
        value = m[group]
        if not re.search(r"[{}<>$]", value) and is_secret(value, "password" if group in (2, 4) or "pass" in m[0].lower() else "secret", words):
            found.append((m.start(group), m.start(group) + len(value.rstrip("\"'`,;)"))))
    for m in LITERAL.finditer(line):
        group = next((i for i in (1, 2, 3) if m[i] is not None), 1)
        value, prefix = m[group], line[: m.start()]
        if len(value) < 4 or " " in value.strip() or any(a <= m.start(group) < b or m.start(group) <= a < m.end(group) for a, b in found):
            continue
        defaulted = DEFAULTED.search(prefix) or FROM_ENV.search(prefix)
        assigned = ASSIGNED.search(prefix)
        if defaulted:
            name = next(g for g in defaulted.groups() if g)
            kind = name_kind(name)
            owner = ASSIGNED.search(prefix[: defaulted.start()].rstrip("os.process. "))
            if kind == "neutral" and owner:
                kind = name_kind(owner[1].rpartition(".")[2])
        elif assigned:
            kind = name_kind(assigned[1].rpartition(".")[2])
        else:
            continue
        if is_secret(value, kind, words):
            found.append(m.span(group))
    remark = REMARK.search(line)
    if remark and re.search(r"(?i)passw|secret|token|api.?key|credential|\bpw\b|login|\bkey\b", remark[1]):
        kind = "password" if re.search(r"(?i)passw|\bpw\b|login", remark[1]) else "secret"
        for m in re.finditer(r"[^\s\"'`,;()<>]{6,}", remark[1]):
            value = m[0].rstrip(".:")
            at = remark.start(1) + m.start()
            value_at = value.rpartition("=")[2] if "=" in value.rstrip("=") else value
            at += len(value) - len(value_at)
            named = re.search(r"(?i)(?:key|token|secret|passw\w*|credential\w*)\b[^:=]{0,30}[:=]\s*$|\blogin\b[^/]{0,40}/\s*$", line[:at])
            if any(a <= at < b for a, b in found) or DIGEST.match(value_at) and not named:
                continue
            mixed = any(c.isdigit() for c in value_at) and any(c.isalpha() for c in value_at)
            if mixed and not re.search(r"[/\\(){}\[\]]|^\W*\w+\.\w+$", value_at) and is_secret(value_at, kind, words) and (len(value_at) >= 12 or kind == "password"):
                found.append((at, at + len(value_at)))
    return sorted(set(found))


def wanted_line(line: Column) -> Column:
    """Whether a line could hold a secret: no line that the judge would take is left out."""
    return line.rlike(SHAPED) | line.rlike(UNNAMED) | (line.rlike(QUOTED) & line.rlike(NAMED)) | (line.rlike(REMARK_START) & line.rlike(r"\p{N}") & line.rlike(REMARKED))


def candidate_lines(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, line_no, line) of the lines of texts (source_table, record_id, text) that could hold a secret."""
    lines = texts.select("source_table", "record_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(wanted_line(F.col("line"))).select("source_table", "record_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def code_texts(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_table, record_id, text, ingested_at) of all texts of both tables; null and empty ones are no case."""
    a = files.select(F.lit("files").alias("source_table"), F.col("file_id").alias("record_id"), F.col("content").alias("text"), "ingested_at")
    b = entities.select(F.lit("code_entities").alias("source_table"), F.col("entity_id").alias("record_id"), F.col("code").alias("text"), "ingested_at")
    return a.unionByName(b).where("record_id is not null and text is not null and text != ''")


def find_secrets(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(source_table, record_id, line_no, begins, ends) of each secret in texts (source_table, record_id, text).

    Lines are parted by \\n and count from 1; `begins` and `ends` are offsets of characters in the
    line, from 0. A secret of several lines, as a private key, stands at its first line. Repeated rows
    give their secrets once; null ids and texts give none; lines are judged one by one, so a text of any
    length is no group of its own.
    """
    vocabularies = path or TOKENIZERS
    ship(texts.sparkSession)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(vocabularies)
        for batch in batches:
            spans = [find_values(line, words) for line in batch["line"]]
            counts = [len(s) for s in spans]
            rows = batch[["source_table", "record_id", "line_no"]].loc[batch.index.repeat(counts)]
            flat = [span for s in spans for span in s]
            yield rows.assign(begins=[a for a, _ in flat], ends=[b for _, b in flat])

    schema = "source_table string, record_id long, line_no long, begins int, ends int"
    return candidate_lines(texts).mapInPandas(judge, schema).distinct()


def first_deliveries(texts: DataFrame) -> DataFrame:
    """Rows of texts (source_table, record_id, ingested_at, ...) without those that were delivered again later.

    Only ids and arrivals are shuffled; the later ones are few and are taken out by an anti-join.
    Rows that arrived together are kept.
    """
    keys = ["source_table", "record_id"]
    earliest = texts.groupBy(*keys).agg(F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"), F.collect_set("ingested_at").alias("all")).where("last > first")
    later = earliest.select(*keys, F.explode(F.array_except("all", F.array("first"))).alias("ingested_at"))
    return texts.join(later, [*keys, "ingested_at"], "left_anti")


def redact(texts: DataFrame, path: str | None = None, placeholder: str = "<secret>") -> DataFrame:
    """`texts` (text, ...) with each secret replaced by the placeholder; every other character stays.

    The body of a private key goes with its first line, up to the END line. Each text is covered
    where it lies; nothing is shuffled. Null stays null, repeated rows are covered each.
    """
    vocabularies = path or TOKENIZERS
    ship(texts.sparkSession)

    @F.pandas_udf("string")
    def cover(text: pd.Series, lines: pd.Series) -> pd.Series:
        words = _words(vocabularies)
        done = []
        for whole, wanted in zip(text, lines):
            if wanted is not None and len(wanted):
                parts = whole.split("\n")
                spots = [{"line_no": at + 1, "begins": a, "ends": b} for at in wanted for a, b in find_values(parts[at], words)]
                whole = _covered(whole, spots, placeholder) if spots else whole
            done.append(whole)
        return pd.Series(done, dtype="object")

    numbered = F.transform(F.split("text", "\n"), lambda line, at: F.when(wanted_line(line), at))
    return texts.withColumn("text", cover("text", F.filter(numbered, lambda at: at.isNotNull())))


def _covered(text: str, spots: list[dict], placeholder: str) -> str:
    lines = text.split("\n")
    for spot in sorted(spots, key=lambda s: (-s["line_no"], -s["begins"])):
        at = spot["line_no"] - 1
        line = lines[at]
        multiline = PRIVATE_KEY.match(line, spot["begins"]) and "-----END" not in line
        lines[at] = line[: spot["begins"]] + placeholder + line[spot["ends"] :]
        if multiline:
            end = next((i for i in range(at + 1, len(lines)) if "-----END" in lines[i]), None)
            if end is not None:
                rest = re.sub(r"^.*?-----END [A-Z0-9 ]*-----", "", lines[end])
                lines[at : end + 1] = [lines[at] + rest]
    return "\n".join(lines)
