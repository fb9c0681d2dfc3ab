"""Personal details in free text, found by a skip-chain conditional random field.

Every token of a document is a node. Neighbours share a chain potential; a word and its next
repetition, or the next word that is similar to it, share a skip potential; loopy message passing
settles the labels of a whole batch of documents together. All weights, of features, chain and
skips, are fitted at once by the field's own likelihood on a bounded sample of documents, whose
labels come from the names of contributors and the written forms of details. While it is fitted,
part of the names and of all other capitalised words is withheld, so that contexts and repetitions
carry the weight that names nobody listed need.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship

LABELS = ("O", "B-name", "I-name", "B-address", "I-address", "phone", "id_number", "email")
INDEX = {label: i for i, label in enumerate(LABELS)}
#: Bound of what the driver sees of the documents: so many are fitted on. Every document is labelled.
FIT_DOCUMENTS = 1500
#: Names of people are known by the bucket of their hash, of so many: the size of the lexicon doesn't grow with theirs.
LEXICON_BITS = 20
#: Weights are known by the bucket of their feature's hash.
WEIGHT_BITS = 17
ROUNDS, EPOCHS, FIT_BATCH = 4, 8, 50
#: Part of the words that a pass withholds, and the part of the documents in which a word must occur not to be withheld.
WITHHELD, COMMON = 0.5, 0.004
DOCUMENTS_A_GRAPH = 128
#: Tokens between two documents of a batch, all O: no feature and no message crosses them.
PAD = 4

_LETTER = r"[^\W\d_぀-ヿ一-鿿]"
_LOCAL = r"A-Za-z0-9À-ɏ_%+"
#: The forms in which details are written.
EMAIL = rf"(?<![{_LOCAL}-])[{_LOCAL}][{_LOCAL}.'-]*+@(?!\d+\.\d)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=[A-Za-z]{{2}})(?![:/]\w)"
PHONE = (
    r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ ./-]?\d{2,8}){1,5}|00\d{2}[ ./-]?\d{1,4}(?:[ ./-]?\d{2,8}){1,4}|\(0?\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}"
    r"|(?<![\d.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![.-]?\d)|0\d{1,4}[/ -]\d{3,8}(?:[ -]\d{2,6})+|0\d(?: \d{2}){4}|0\d{2} \d{4} \d{4})"
)
IDS = {
    "ssn": r"\d{3}-\d{2}-\d{4}", "spaced": r"\d{3} \d{2} \d{4}", "taxid": r"\d{2} \d{3} \d{3} \d{3}", "eu_tax": r"T-\d{3}-\d{3}-\d{3}", "nino": r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    "licence": r"[A-Z]{5}\d{6}[A-Z]{2}\d", "dni": r"\d{8}-?[A-Z]", "card": r"L\d{2}[A-Z]\d{2}[A-Z]\d{2}", "pass2": r"[A-Z]{2}\d{7}", "pass1": r"[A-Z]\d{8}",
}
STREET = re.compile(r"lane|road|street|avenue|ave|blvd|boulevard|drive|close|court|crescent|way|row|rise|hill|terrace|square|place|rd|st|ln|dr")
STREET_STARTS = frozenset("rue avenue quai impasse calle boulevard place allee chemin avenida plaza paseo am an alte alter zur zum im".split())
STREET_ENDS = ("straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "damm", "bach", "kelterei", "hof", "graben", "ring")
ID_CUES = frozenset("ssn social security passport pass tax taxid id national insurance number personalausweis dni nif licence license driver's employee customer fixture field form doc_no doc_id steuer steuernummer ausweis identity citizen nino record".split())
PHONE_CUES = frozenset("tel phone call telefon teléfono téléphone au 电话 fax mobile contact ask whether back tel:".split())

#: The first form is that of most tokens: a word that goes on with nothing and can't begin an identity number.
TOKEN = re.compile(
    rf"(?P<plain>(?![A-Z]{{1,5}} ?\d){_LETTER}+(?=[\s,;:()\[\]\"，。、]))|(?P<email>{EMAIL})|(?=[A-Z\d])(?<![\w.@+/-])(?P<id>{'|'.join(IDS.values())})(?![\w-]|\.\d)|(?=[+(\d])(?<![\w.@+-])(?P<phone>{PHONE})(?!\w|[.:]\d)"
    rf"|(?P<initial>{_LETTER}\.(?=\s?{_LETTER}))|(?P<word>{_LETTER}+(?:['’\-]{_LETTER}+)*+)|(?P<number>\d+[A-Za-z]?(?!\w))|(?P<mixed>[぀-ヿ一-鿿]+|[^\W぀-ヿ一-鿿]+)|(?P<mark>[^\s\w])"
)
KINDS = ("email", "id", "phone", "initial", "word", "number", "mixed", "mark")
EMAIL_KIND, ID_KIND, PHONE_KIND, INITIAL_KIND, WORD_KIND, NUMBER_KIND, MIXED_KIND, MARK_KIND = range(8)
#: Kinds of the pattern's groups, from 1.
KIND_OF = (None, WORD_KIND, *range(8))


def fold(word: str) -> str:
    """Lower case without marks on letters."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("’", "'").replace("ı", "i")


def _code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def name_parts(name: str | None) -> tuple[str, str] | None:
    """Given and family name of a person's whole name, folded; None for less than two words."""
    parts = [fold(p.strip(",.")) for p in (name or "").split() if len(p.strip(",.")) > 1]
    return (parts[0], parts[-1]) if len(parts) >= 2 else None


class Lexicon:
    """Given and family names of people who are known, as bits of hash buckets: 1 for given, 2 for family."""

    def __init__(self, names: list[str] = (), bits: int = LEXICON_BITS):
        self.known = np.zeros(1 << bits, dtype=np.uint8)
        for name in names:
            for which, part in enumerate(name_parts(name) or ()):
                self.known[_code(part) & (len(self.known) - 1)] |= 1 << which

    def bits_of(self, folded: str) -> int:
        return int(self.known[_code(folded) & (len(self.known) - 1)])


class Rows(dict):
    """Row numbers of the tokens of one kind; a new token is described when it is first seen."""

    def __init__(self, table: Table, kind: int):
        super().__init__()
        self.table, self.kind = table, kind

    def __missing__(self, text: str) -> int:
        at = self[text] = len(self.table.values)
        self.table.values.append(self.table.describe(text, self.kind))
        return at


class Table:
    """What is known of each distinct token, as numbers."""

    COLUMNS = ("kind", "shape", "word", "known", "street", "ending", "alike", "cues")
    REMEMBERED = 300_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.rows = [Rows(self, kind) for kind in range(len(KINDS))]
        self.values: list[tuple[int, ...]] = []

    def forget(self) -> None:
        """Begins anew once very many are remembered; rows given before are no longer valid."""
        if len(self.values) > self.REMEMBERED:
            self.rows, self.values = [Rows(self, kind) for kind in range(len(KINDS))], []

    def array(self) -> np.ndarray:
        return np.asarray(self.values, dtype=np.int64).reshape(-1, len(self.COLUMNS))

    def describe(self, text: str, kind: int) -> tuple[int, ...]:
        low = fold(text) if kind in (WORD_KIND, MIXED_KIND, INITIAL_KIND) else text
        known = self.lexicon.bits_of(low) if kind == WORD_KIND else 0
        shape, street, ending, alike, cues = KINDS[kind], 0, 0, 0, 0
        if kind == WORD_KIND:
            shape = "AA" if len(text) > 1 and text.isupper() else "Aa" if text[0].isupper() else "aa"
            street = 1 if STREET.fullmatch(low) else 2 if low in STREET_STARTS else 3 if len(low) > 5 and low.endswith(STREET_ENDS) else 0
            ending = _code(low[-3:]) if len(low) > 4 else 0
            bare = re.sub(r"['-]", "", low)
            alike = _code(bare[:5]) if len(bare) >= 3 else 0
        elif kind == ID_KIND:
            shape = next(name for name, form in IDS.items() if re.fullmatch(form, text))
            alike = _code(text)
        elif kind == NUMBER_KIND:
            shape = f"9{min(len(text), 6)}" + ("a" if text[-1].isalpha() else "")
        elif kind in (EMAIL_KIND, PHONE_KIND):
            alike = _code(text.lower())
        elif kind == MIXED_KIND:
            shape = "mixed" + ("A" if text.isupper() else "") + str(min(len(text), 4))
        if kind in (WORD_KIND, MIXED_KIND):
            pieces = {low, *re.split(r"[_'-]", low)}
            cues = bool(pieces & ID_CUES) + 2 * bool(pieces & PHONE_CUES)
        word = _code(low) if kind in (WORD_KIND, MARK_KIND, MIXED_KIND) else 0
        return kind, _code(shape), word, known, street, ending, alike, cues


_SHAPES = {name: _code(name) for name in ("Aa", "AA", "aa")}


def spans_of(matches: Iterable[re.Match]) -> list[tuple[int, int, int]]:
    """(begin, end, kind) of tokens."""
    return [(m.start(), m.end(), KIND_OF[m.lastindex]) for m in matches]


def tokenize(text: str) -> list[tuple[int, int, int]]:
    """All tokens of a text."""
    return spans_of(TOKEN.finditer(text))


class Graph:
    """The tokens of a batch of documents in a row, parted by pads, with what their features and edges need."""

    def __init__(self, texts: list[str | None], table: Table):
        table.forget()
        by_kind = [None, *[table.rows[kind] for kind in KIND_OF[1:]]]
        pad = table.rows[MARK_KIND][""]
        rows, self.matches, self.begins = [pad] * PAD, [], []
        for text in texts:
            matches = list(TOKEN.finditer(text)) if text else []
            self.begins.append(len(rows))
            self.matches.append(matches)
            rows += [by_kind[m.lastindex][m[0]] for m in matches]
            rows += [pad] * PAD
        self.columns = dict(zip(Table.COLUMNS, table.array()[np.asarray(rows)].T))
        self.pad = np.ones(len(rows), dtype=bool)
        self.document = np.zeros(len(rows), dtype=np.int64)
        for n, (begin, matches) in enumerate(zip(self.begins, self.matches)):
            self.pad[begin : begin + len(matches)] = False
            self.document[begin : begin + len(matches)] = n
        self.skips, self.equal = self._skip_edges()

    def _skip_edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(earlier, later) places of a repeated or similar word and its next occurrence, and whether both are equal.

        Words alike in their first five letters are linked where one of them isn't in lower case, or is a known name.
        """
        c = self.columns
        places = np.flatnonzero((c["alike"] != 0) & ~self.pad)
        key = self.document[places] * (1 << 33) + c["alike"][places]
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        marked = (c["shape"][places] != _SHAPES["aa"]) | (c["known"][places] > 0)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        group = np.repeat(np.maximum.reduceat(marked, new), np.diff(np.r_[new, len(key)])) if len(key) else marked
        linked = np.flatnonzero((key[1:] == key[:-1]) & group[1:])
        edges = np.stack([places[linked], places[linked + 1]], axis=1)
        return edges, c["word"][edges[:, 0]] == c["word"][edges[:, 1]]

    def features(self, withheld: np.ndarray | None = None) -> np.ndarray:
        """Buckets of the weights that speak at each token, a row a token; bucket 0 says nothing.

        Of withheld tokens it isn't known which word they are, nor whether it is a name.
        """
        c = {name: column.astype(np.uint64) for name, column in self.columns.items()}
        shape, street, known, word, ending = c["shape"], c["street"], c["known"], c["word"], c["ending"]
        if withheld is not None:
            known, word, ending = (np.where(withheld, np.uint64(0), x) for x in (known, word, ending))
        plain = np.isin(self.columns["kind"], (WORD_KIND, MARK_KIND)) & (self.columns["shape"] != _SHAPES["Aa"]) & (word != 0)
        form = np.where(known > 0, known + np.uint64(7), np.where(plain, word, shape))
        at = lambda x, step: np.roll(x, -step)
        pair = lambda x, y: x * np.uint64(0x9E3779B97F4A7C15) + y
        near = np.zeros(len(shape), dtype=np.uint64)
        for bit in (1, 2):
            total = np.r_[0, np.cumsum((self.columns["cues"] & bit) > 0)]
            n = np.arange(len(shape))
            near += np.uint64(bit) * (total[np.minimum(n + 4, len(shape))] > total[np.maximum(n - 8, 0)]).astype(np.uint64)
        shapes = pair(at(shape, -1), at(shape, 1))
        found = [
            shape, pair(word, np.uint64(1)), pair(known, shape), street, ending, pair(near + np.uint64(1), shape),
            at(form, -3), at(form, -2), at(form, -1), at(form, 1), at(form, 2), at(form, 3),
            pair(at(form, -1), form), pair(form, at(form, 1)), pair(at(form, -2), at(form, -1)), pair(at(form, 1), at(form, 2)),
            pair(at(street, -1), shape), pair(at(street, 1), shape), pair(at(street, 2), shape), pair(at(street, -2), shape), pair(shapes, shape), pair(pair(at(form, -1), shape), at(form, 1)),
            pair(pair(at(shape, -2), at(shape, -1)), shape), pair(pair(at(shape, 1), at(shape, 2)), shape), pair(at(word, -1), shape), pair(word, at(form, 1)),
        ]
        buckets = np.empty((len(shape), len(found)), dtype=np.int32)
        for place, values in enumerate(found):
            mixed = (values + np.uint64(place + 1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            buckets[:, place] = (mixed >> np.uint64(64 - WEIGHT_BITS)).astype(np.int32)
        for place, values in ((1, word), (4, ending)):
            buckets[values == 0, place] = 0
        return buckets


_ONES = np.ones((len(LABELS), 1), dtype=np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / (x @ _ONES)


class Field:
    """Log weights of features, of the labels of neighbours, and of those of equal and of similar words."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights.astype(np.float32), chain.astype(np.float32), skip.astype(np.float32)

    def local(self, graph: Graph, buckets: np.ndarray) -> np.ndarray:
        """What each token says for itself of its labels, the largest 1."""
        scores = np.zeros((len(buckets), len(LABELS)), dtype=np.float32)
        for place in range(buckets.shape[1]):
            scores += self.weights[buckets[:, place]]
        scores[graph.pad] = -20.0
        scores[graph.pad, 0] = 0.0
        return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -20.0))

    def messages(self, graph: Graph, local: np.ndarray) -> tuple[np.ndarray, ...]:
        """What reaches each node from its left and right neighbour, its earlier and its later kin, after `ROUNDS` of messages."""
        chain, skip = np.exp(self.chain), np.exp(self.skip)
        left, right, earlier, later = (np.full_like(local, 1 / len(LABELS)) for _ in range(4))
        a, b = graph.skips[:, 0], graph.skips[:, 1]
        kinds = [(graph.equal, skip[0]), (~graph.equal, skip[1])]
        for _ in range(ROUNDS):
            kin = local * earlier * later
            to_right, to_left = (kin * left) @ chain, (kin * right) @ chain.T
            left[1:], right[:-1] = _normal(to_right[:-1]), _normal(to_left[1:])
            if len(a):
                own = local * left * right
                forward, back = (own * earlier)[a], (own * later)[b]
                for which, potential in kinds:
                    later_new, earlier_new = _normal(forward[which] @ potential), _normal(back[which] @ potential.T)
                    earlier[b[which]] = np.sqrt(earlier[b[which]] * later_new)
                    later[a[which]] = np.sqrt(later[a[which]] * earlier_new)
                earlier[b], later[a] = _normal(earlier[b]), _normal(later[a])
        return left, right, earlier, later

    def beliefs(self, graph: Graph, buckets: np.ndarray) -> np.ndarray:
        """Probabilities of the labels of each node."""
        local = self.local(graph, buckets)
        left, right, earlier, later = self.messages(graph, local)
        return _normal(local * left * right * earlier * later)

    def gradient(self, graph: Graph, buckets: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(surplus of each node, and of the chain and skip potentials): counts of the truth less expected counts, and the beliefs."""
        n = len(LABELS)
        local = self.local(graph, buckets)
        left, right, earlier, later = self.messages(graph, local)
        beliefs = _normal(local * left * right * earlier * later)
        wanted = np.eye(n, dtype=np.float32)[truth]
        real = ~(graph.pad[:-1] & graph.pad[1:])

        def surplus(ahead: np.ndarray, behind: np.ndarray, potential: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
            joint = ahead[:, :, None] * np.exp(potential)[None] * behind[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            return wanted[p].T @ wanted[q] - joint.sum(axis=0)

        p = np.flatnonzero(real)
        kin = local * earlier * later
        chain = surplus((kin * left)[p], (kin * right)[p + 1], self.chain, p, p + 1)
        skip = np.zeros_like(self.skip)
        own = local * left * right
        for kind, which in enumerate((graph.equal, ~graph.equal)):
            a, b = graph.skips[which, 0], graph.skips[which, 1]
            if len(a):
                skip[kind] = surplus((own * earlier)[a], (own * later)[b], self.skip[kind], a, b)
        unary = wanted - beliefs
        unary[graph.pad] = 0.0
        return unary, chain, skip, beliefs


#: The written form of an address, for the labels of the sample.
_PLACE = r"[A-ZÀ-Þ][\w'’-]+"
_CODE = r"(?: \d{5}(?:-\d{4})?| [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2,3})"
RULE_ADDRESS = re.compile(
    rf"(?:Flat \d+, )?\b\d+[A-Za-z]? (?:[A-Z][\w'’-]+ )+(?i:{STREET.pattern})\b(?: (?i:{STREET.pattern}))?, {_PLACE}{_CODE}?"
    rf"|\b\d+(?: bis| ter)? (?:rue|avenue|quai|impasse|boulevard|place|allée|chemin)(?: [\w'’-]+)+, \d{{5}} {_PLACE}"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo)(?: [\w'’-]+)+ \d+[A-Za-z]?, \d{{5}} {_PLACE}"
    rf"|\b(?:(?:Am|An der|Alte|Alter|Zur|Zum|Im) [A-ZÄÖÜ]\w+|[A-ZÄÖÜ]\w+(?:straße|strasse|weg|gasse|platz|allee|ufer)) \d+[a-z]?, \d{{5}} {_PLACE}"
)
NOT_IDS = re.compile(r"(?i)\b(?:range|order|lines?|epoch|shard|build|version|ticket|timings|code)\b[^.;\n]{0,12}$")


def rule_labels(text: str, tokens: list[tuple[int, int, int]], lexicon: Lexicon) -> list[int]:
    """The labels that listed names and written forms give to the tokens of a text of the fitting sample."""
    labels = [0] * len(tokens)
    known = [lexicon.bits_of(fold(text[a:b])) if kind == WORD_KIND else 0 for a, b, kind in tokens]

    def mark(a: int, b: int, kind: str) -> None:
        for place, i in enumerate(range(a, b)):
            labels[i] = INDEX[f"{'I' if place else 'B'}-{kind}"]

    for i, (begin, _, kind) in enumerate(tokens):
        before = text[max(0, begin - 60) : begin]
        if kind == EMAIL_KIND and "://" not in before[-12:]:
            labels[i] = INDEX["email"]
        elif kind in (PHONE_KIND, ID_KIND) and not NOT_IDS.search(before):
            labels[i] = INDEX["phone" if kind == PHONE_KIND else "id_number"]
    for m in RULE_ADDRESS.finditer(text):
        inside = [i for i, (a, b, _) in enumerate(tokens) if a >= m.start() and b <= m.end()]
        if inside:
            mark(inside[0], inside[-1] + 1, "address")
    i = 0
    while i < len(tokens):
        end = _name_end(text, tokens, known, i)
        if end and not any(labels[i:end]):
            mark(i, end, "name")
            i = end
        else:
            i += 1
    return labels


def _name_end(text: str, tokens: list[tuple[int, int, int]], known: list[int], i: int) -> int:
    """Where a name of known parts ends that begins at i; 0 if none does."""
    n = len(tokens)
    initial = lambda k: k < n and tokens[k][2] == INITIAL_KIND
    if initial(i) or known[i] & 1:
        j = i + 1
        while initial(j):
            j += 1
        if j < n and known[j] & 2 and not (initial(i) and i and known[i - 1] & 1):
            return j + 1
    if known[i] & 2:
        j = i + 1
        comma = j < n and text[tokens[j][0] : tokens[j][1]] == ","
        j += comma
        if j < n and (known[j] & 1 or initial(j) and comma):
            j += 1
            while initial(j) and not (j + 1 < n and known[j + 1] & 2):
                j += 1
            return j
    return 0


def _joint(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.bincount(a[where] * len(LABELS) + b[where], minlength=len(LABELS) ** 2).reshape(len(LABELS), -1)


def _affinity(counts: np.ndarray) -> np.ndarray:
    """How much more often two labels meet than by chance, as a smoothed logarithm."""
    chance = np.outer(counts.sum(axis=1), counts.sum(axis=0)) / max(counts.sum(), 1)
    return np.clip(np.log((counts + 1) / (chance + 1)), -4, 4)


def fit(texts: list[str], lexicon: Lexicon, seed: int = 7, epochs: int = EPOCHS) -> Field:
    """Ascends the field's likelihood, its expected counts taken by message passing, all weights together.

    In every other pass, but not in the last two, a part `WITHHELD` of the known names and of the
    capitalised words that aren't common is withheld: in all places of a document, so that only
    their context and their kin speak for them. Without texts all weights are 0 and every token is O.
    """
    rng = np.random.default_rng(seed)
    n = len(LABELS)
    field = Field(np.zeros((1 << WEIGHT_BITS, n)), np.zeros((n, n)), np.zeros((2, n, n)))
    table = Table(lexicon)
    cases = []
    seen: Counter[int] = Counter()
    for begin in range(0, len(texts), FIT_BATCH):
        part = texts[begin : begin + FIT_BATCH]
        graph = Graph(part, table)
        truth = np.zeros(len(graph.pad), dtype=np.int64)
        for text, at, matches in zip(part, graph.begins, graph.matches):
            truth[at : at + len(matches)] = rule_labels(text or "", spans_of(matches), lexicon)
        seen.update((np.unique(graph.document * (1 << 32) + graph.columns["word"]) % (1 << 32)).tolist())
        cases.append((graph, truth))
    common = np.asarray([word for word, n in seen.items() if n >= COMMON * len(texts)], dtype=np.int64)
    versions = []
    for graph, _ in cases:
        c = graph.columns
        coin = ((c["word"] * 2654435761 + graph.document * 40503 + int(rng.integers(1 << 30))) >> 7) % 1000
        rare = (c["shape"] != _SHAPES["aa"]) & ~np.isin(c["word"], common)
        withheld = (rare | (c["known"] > 0)) & (c["kind"] == WORD_KIND) & (coin < 1000 * WITHHELD)
        versions.append((graph.features(), graph.features(withheld)))
    # the ascent begins where the labels' own counts put the potentials, and with features that say nothing
    if not cases:
        return field
    field.chain[:] = _affinity(sum(_joint(truth[:-1], truth[1:], ~(graph.pad[:-1] & graph.pad[1:])) for graph, truth in cases))
    for kind in (0, 1):
        found = sum(_joint(truth[graph.skips[:, 0]], truth[graph.skips[:, 1]], graph.equal == (kind == 0)) for graph, truth in cases)
        field.skip[kind] = _affinity(found + np.transpose(found))
    squares = np.full(field.weights.shape, 1e-3, dtype=np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.chain, field.skip)]
    steps = 0
    for epoch in range(epochs):
        for at in rng.permutation(len(cases)):
            graph, truth = cases[at]
            buckets = versions[at][epoch % 2 if epoch < epochs - 2 else 0]
            unary, chain, skip, _ = field.gradient(graph, buckets, truth)
            told = np.flatnonzero(np.abs(unary).max(axis=1) > 1e-3)
            touched, inverse = np.unique(buckets[told], return_inverse=True)
            inverse = inverse.reshape(-1)
            repeated = np.repeat(unary[told], buckets.shape[1], axis=0)
            weights = np.stack([np.bincount(inverse, weights=repeated[:, k], minlength=len(touched)) for k in range(n)], axis=1).astype(np.float32)
            weights[touched == 0] = 0.0
            squares[touched] += weights**2
            field.weights[touched] += 0.2 * weights / np.sqrt(squares[touched])
            steps += 1
            for current, slope, (mean, square) in zip((field.chain, field.skip), (chain, skip), moments):
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope**2 - square)
                current += 0.03 * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.99**steps)) + 1e-6)
                np.clip(current, -5, 5, out=current)
    return field


def _spans(text: str, tokens: list[tuple[int, int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the details that the labels of a text make; a name needs two parts, an address a number and two words."""
    spans: list[tuple[str, int, int]] = []
    i = 0
    while i < len(tokens):
        label = LABELS[labels[i]]
        if label == "O":
            i += 1
            continue
        kind = label.removeprefix("B-").removeprefix("I-")
        j = i + 1
        if kind in ("name", "address"):
            # no detail goes on in another line
            while j < len(tokens) and LABELS[labels[j]] == f"I-{kind}" and "\n" not in text[tokens[j - 1][1] : tokens[j][0]]:
                j += 1
        part = tokens[i:j]
        while part and part[-1][2] == MARK_KIND and text[part[-1][0]] != ")":
            part = part[:-1]
        while part and part[0][2] == MARK_KIND:
            part = part[1:]
        kinds = [k for _, _, k in part]
        if kind == "name":
            ok = WORD_KIND in kinds and kinds.count(WORD_KIND) + kinds.count(INITIAL_KIND) >= 2 and kinds.count(WORD_KIND) <= 3
        elif kind == "address":
            ok = kinds.count(WORD_KIND) >= 2 and (NUMBER_KIND in kinds or MIXED_KIND in kinds)
        else:
            ok = kinds == [{"phone": PHONE_KIND, "id_number": ID_KIND, "email": EMAIL_KIND}[kind]]
        if ok:
            spans.append((kind, part[0][0], part[-1][1]))
        i = j
    return spans


def label_batch(texts: list[str | None], field: Field, table: Table) -> list[list[tuple[str, int, int]]]:
    """The details of each text of a batch, their graphs solved together."""
    graph = Graph(texts, table)
    best = field.beliefs(graph, graph.features()).argmax(axis=1)
    hit = best != 0
    return [
        _spans(text, spans_of(matches), best[at : at + len(matches)]) if hit[at : at + len(matches)].any() else []
        for text, at, matches in zip(texts, graph.begins, graph.matches)
    ]


def read_lexicon(contributors: DataFrame, bits: int = LEXICON_BITS) -> Lexicon:
    """The lexicon of all `full_name`s; at most two bits of each of 2^`bits` buckets reach the driver, however many names there are."""

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(_code(part) & ((1 << bits) - 1), 1 << which) for name in batch["full_name"] for which, part in enumerate(name_parts(name) or ())}
            yield pd.DataFrame(sorted(rows), columns=["bucket", "bit"])

    ship(contributors.sparkSession)
    names = contributors.where("full_name is not null").select("full_name").distinct().mapInPandas(buckets, "bucket int, bit int")
    lexicon = Lexicon(bits=bits)
    for row in names.groupBy("bucket").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        lexicon.known[row.bucket] = row.bits
    return lexicon


def find_personal(docs: DataFrame, contributors: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, kind, found, begins, ends) of each personal detail in docs (doc_id, text).

    * `found` is exactly as in the text from character `begins` to `ends`. Kinds: email, phone,
      id_number, name, address.
    * Null, empty and blank texts have none; repeated rows give theirs each; a null doc_id is kept.
      A text of any length is one graph with as many nodes as tokens.
    * The field is fitted on the `fit_documents` documents with the least hash of their id; every
      document is labelled. Without contributors no name is known and none is learned.
    """
    lexicon = read_lexicon(contributors)
    sample = docs.where("text is not null and text != ''").select("text", F.xxhash64("doc_id").alias("at")).orderBy("at", "text").limit(fit_documents)
    field = fit([r.text for r in sample.collect()], lexicon)
    model = docs.sparkSession.sparkContext.broadcast((field, lexicon))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, lexicon = model.value
        table = Table(lexicon)
        for batch in batches:
            ids, texts = batch["doc_id"], list(batch["text"])
            for begin in range(0, len(batch), DOCUMENTS_A_GRAPH):
                part = texts[begin : begin + DOCUMENTS_A_GRAPH]
                rows = [
                    (doc, kind, text[a:b], a, b)
                    for doc, text, spans in zip(ids.iloc[begin : begin + DOCUMENTS_A_GRAPH], part, label_batch(part, field, table))
                    for kind, a, b in spans
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "found", "begins", "ends"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.mapInPandas(label, "doc_id long, kind string, found string, begins int, ends int")


def replace_personal(docs: DataFrame, details: DataFrame) -> DataFrame:
    """`docs` with each detail replaced by a placeholder of its kind, as <EMAIL>; all other text is kept."""
    spots = details.groupBy("doc_id").agg(F.collect_set(F.struct("begins", "ends", "kind")).alias("_spots"))

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spots: pd.Series) -> pd.Series:
        done = []
        for text, places in zip(texts, spots):
            for spot in sorted(places if places is not None else (), key=lambda s: -s["begins"]):
                text = f"{text[: spot['begins']]}<{spot['kind'].upper()}>{text[spot['ends'] :]}"
            done.append(text)
        return pd.Series(done, dtype="object")

    return docs.join(spots, "doc_id", "left").withColumn("text", cover("text", "_spots")).drop("_spots")
