"""Personal details in free text, by a skip-chain conditional random field.

Every text is one chain of tokens with the labels O and B/I of five kinds.
Scores come from features of the tokens around (word, shape, prefix, suffix, class of
the word, whether the collection uses it as a common word), from patterns of numbers and addresses as
further observations, and from transitions. Tokens of a text that are equal or alike are joined
by skip edges whose potentials are learned; messages are passed along the
chain and over these edges, several times over, so that a name found where
the context is plain is also found where it isn't. What is found is what the field labels.

No text is labelled. Training has three sources: texts labelled by functions
(patterns, places that name somebody in any collection, given names learned from these), the same
texts with other names, and made texts, whose lines come from the collection
and whose details are invented. In the last two, words and patterns are hidden at random, so that
no detail is known by its own words or its cue alone. The sample is bounded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.details import ANY, CLASSES, GIVEN, INITIAL, KINDS, PLAIN, STREET_END, Maker, Spans, cued_names, labelled_patterns
from twinweave.session import draw, spread

#: O, then B and I of each kind.
N_LABELS = 1 + 2 * len(KINDS)
N_KINDS = 1 + len(KINDS)
#: Texts in the training sample, at most.
SAMPLE = 8000
#: Characters of a text in the training sample, at most; longer texts are searched like all others, but don't train.
LONGEST = 20_000
#: Made texts.
MADE = 6500
#: Features of tokens that a model knows, at most, and the tokens to either side whose features count.
FEATURES, REACH = 1 << 15, 3
#: Given names, and common words, that a model knows, at most.
GIVEN_NAMES, COMMON = 20_000, 50_000
#: Rounds of messages over the skip edges.
ROUNDS = 3
#: Tokens of a chain in training, which is cut at line ends; in use no chain is cut.
PIECE = 80

#: A token, with the blank before it, or other white space; they cover a text.
_TOKEN = re.compile(r"[ \t]?(?:\w+|[^\w\s]|\r?\n)|\s")
#: Marks a token whose word is hidden, and one of which it isn't known either whether it is a common word.
_HIDDEN, _STRANGE = "\0", "\1"
#: Kind of each label, 0 for O.
_KIND = np.array([0, *[1 + i // 2 for i in range(2 * len(KINDS))]])
_BY_KIND = np.eye(N_KINDS, dtype=np.float32)[_KIND]


def tokens_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens with the blank before them, where they start without it, and where they end."""
    keys = _TOKEN.findall(text)
    n = len(keys)
    size = np.fromiter(map(len, keys), np.int64, n)
    end = np.cumsum(size)
    size -= np.fromiter([k[0] in " \t" for k in keys], bool, n)
    blank = np.fromiter([k[-1] != "\n" and k.isspace() for k in keys], bool, n)
    if blank.any():
        on = ~blank
        keys = [k for k, x in zip(keys, on) if x]
        size, end = size[on], end[on]
    return keys, end - size, end


def _shape(w: str) -> str:
    s = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in w[:12])
    return re.sub(r"(.)\1+", r"\1+", s) if len(s) > 2 else s


N_FEATURES = 9


def token_features(key: str, given: frozenset[str], common: frozenset[str]) -> tuple[str, ...]:
    """Features of a token by itself."""
    hidden, strange = key[0] in _HIDDEN + _STRANGE, key[0] == _STRANGE
    key = key[1:] if hidden else key
    spaced = key[0] in " \t"
    w = key[1:] if spaced else key
    low = w.lower()
    digits = sum(c.isdigit() for c in w)
    case = "U" if len(w) > 1 and w.isupper() else "C" if w[:1].isupper() else "l" if w[:1].islower() else "0" if digits else "x"
    classes = CLASSES.get(low, "") + ("Gi" if low in given and not hidden else "") + ("Se" if STREET_END.fullmatch(low) else "")
    known = "y" if low in common and not strange else "n"
    word = "?" if hidden and case != "x" else low if not digits else re.sub(r"[0-9]", "0", low)[:10]
    return (
        f"w={word}", f"s={_shape(w)}", f"p={'?' if hidden else low[:3]}", f"e={'?' if hidden else low[-3:]}", f"l={min(len(w), 12)}{case}{digits > 0}",
        f"k={known}{case}", f"c={classes}{case}", f"b={spaced}{case}{w if case == 'x' else ''}", f"d={min(digits, 9)}{digits == len(w)}{spaced}",
    )


#: Classes of tokens of which three in a row are a feature; 0 is the space between texts.
N_CLASSES = 16


def token_class(key: str, given: frozenset[str], common: frozenset[str]) -> int:
    """Break, punctuation, number, initial, or word, by its letter case and whether it is a common word or a given name."""
    hidden = key[0] in _HIDDEN + _STRANGE
    w = key.lstrip(_HIDDEN + _STRANGE + " \t")
    if not w or not w[0].isalnum():
        return 1 if key.endswith("\n") else {".": 2, ",": 3, ":": 4, "<": 5, "@": 5, "-": 6}.get(w, 7)
    if w[0].isdigit():
        return 8
    low = w.lower()
    if low in common and key[0] != _STRANGE:
        return 10 if w[0].isupper() else 9
    if len(w) == 1:
        return 11
    if w[0].islower() or not w.isalpha():
        return 15 if low in given and not hidden else 12
    return 15 if low in given and not hidden else 14 if w.isupper() else 13


def _grams(c: np.ndarray) -> list[np.ndarray]:
    """Three classes in a row, up to each token, around it and from it on."""
    p = np.concatenate([[0, 0], c, [0, 0]]).astype(np.int64)
    n = len(c)
    code = lambda a: (p[a : a + n] * N_CLASSES + p[a + 1 : a + 1 + n]) * N_CLASSES + p[a + 2 : a + 2 + n]
    return [code(0), code(1), code(2)]


def _codes(start: np.ndarray, end: np.ndarray, marks: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token of marked pieces of text."""
    out = np.zeros(len(start), np.int8)
    for a, b, k in marks:
        i, j = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        if i < j:
            out[i:j] = 2 + 2 * k
            out[i] = 1 + 2 * k
    return out


@dataclass
class Model:
    """token: (2 * REACH + 1, features, labels), features numbered by ``features`` (at most FEATURES; 0 is that of all unknown ones and weighs nothing); pattern: (3, labels, labels) of the marks before, at and after a token; step: transitions.

    gram: (3, classes ** 3, labels) of three classes in a row. skip: potentials of the two sorts of skip edges (equal, alike) by the kinds at their ends; given and common: words the collection
    uses as given names and as common words, at most GIVEN_NAMES and COMMON.
    """

    token: np.ndarray
    pattern: np.ndarray
    step: np.ndarray
    gram: np.ndarray
    skip: np.ndarray = field(default_factory=lambda: np.zeros((2, N_KINDS, N_KINDS), np.float32))
    given: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    features: dict[str, int] = field(default_factory=dict)

    def numbers(self, key: str) -> list[int]:
        """Of a token's features."""
        return [self.features.get(f, 0) for f in token_features(key, self.given, self.common)]

    @classmethod
    def empty(cls, given: frozenset[str] = frozenset(), common: frozenset[str] = frozenset(), features: dict[str, int] | None = None) -> Model:
        features = features or {}
        return cls(np.zeros((2 * REACH + 1, len(features) + 1, N_LABELS), np.float32), np.zeros((3, N_LABELS, N_LABELS), np.float32), _allowed(), np.zeros((3, N_CLASSES**3, N_LABELS), np.float32), given=given, common=common, features=features)


def _allowed() -> np.ndarray:
    """0 for transitions that can be, a large loss for an I that doesn't go on with its kind."""
    step = np.zeros((N_LABELS, N_LABELS), np.float32)
    for k in range(len(KINDS)):
        step[:, 2 + 2 * k] = -30
        step[1 + 2 * k, 2 + 2 * k] = step[2 + 2 * k, 2 + 2 * k] = 0
    return step


class Coder:
    """Scores tokens; remembers what a word contributes."""

    LIMIT = 60_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, *model.token.shape[::2]), np.float32)
        self.classes = np.zeros(1024, np.int64)
        #: numbers of the words and stems of skip edges
        self.joined = np.zeros((2, 1024), np.int64)
        self.names: dict[str, int] = {"": 0}

    def encode(self, keys: list[str]) -> np.ndarray:
        """Ids of tokens; 0 is that of the space between texts."""
        ids, model = self.ids, self.model
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys):
            n = ids.get(key)
            if n is None:
                n = ids[key] = len(ids) + 1
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.classes = np.concatenate([self.classes, np.zeros_like(self.classes)])
                    self.joined = np.concatenate([self.joined, np.zeros_like(self.joined)], 1)
                self.classes[n] = token_class(key, model.given, model.common)
                self.joined[:, n] = [self.names.setdefault(x, len(self.names)) for x in skip_words(key, model.common)]
                self.table[n] = model.token[:, model.numbers(key)].sum(1)
            out[i] = n
        return out

    def forget(self) -> None:
        """Between batches: bound what is remembered."""
        if len(self.ids) > self.LIMIT:
            self.ids.clear()
            self.names = {"": 0}

    def scores(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(tokens, labels) of texts one after the other, REACH ids of 0 before, between and after them."""
        n = len(ids)
        model = self.model
        out = model.pattern[1][codes]
        out[1:] += model.pattern[0][codes[:-1]]
        out[:-1] += model.pattern[2][codes[1:]]
        for gram, at in zip(model.gram, _grams(self.classes[ids])):
            out += gram[at]
        for o in range(-REACH, REACH + 1):
            a, b = max(0, -o), min(n, n - o)
            out[a:b] += self.table[ids[a + o : b + o], o + REACH]
        return out


def marginals(scores: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(label marginals, expected transitions, sum of log partition functions) of padded chains (chains, tokens, labels)."""
    b, t, k = scores.shape
    e = np.exp(step)
    top = scores.max(2, keepdims=True)
    x = np.exp(scores - top)
    fwd = np.empty_like(x)
    norm = np.ones((b, t), np.float32)
    f = x[:, 0]
    norm[:, 0] = f.sum(1)
    fwd[:, 0] = f / norm[:, :1]
    on = np.arange(t)[None, :] < lengths[:, None]
    for i in range(1, t):
        f = (fwd[:, i - 1] @ e) * x[:, i]
        norm[:, i] = f.sum(1)
        fwd[:, i] = f / norm[:, i : i + 1]
    back = np.ones((b, k), np.float32)
    out = np.empty_like(x)
    moves = np.zeros((k, k), np.float64)
    for i in range(t - 1, -1, -1):
        live = on[:, i]
        back[~live] = 1
        p = fwd[:, i] * back
        p /= p.sum(1, keepdims=True)
        out[:, i] = p
        if i:
            right = x[:, i] * back / norm[:, i : i + 1]
            if live.any():
                moves += (fwd[live, i - 1].T @ right[live]) * e
            back = right @ e.T
    log_z = float(((np.log(norm) + top[:, :, 0]) * on).sum())
    return out, moves, log_z


def best_labels(scores: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The best labels of each padded chain."""
    b, t, _ = scores.shape
    best = scores[:, 0].copy()
    came = np.zeros((b, t, N_LABELS), np.int8)
    on = np.arange(t)[None, :] < lengths[:, None]
    for i in range(1, t):
        both = best[:, :, None] + step[None]
        came[:, i] = both.argmax(1)
        best = np.where(on[:, i : i + 1], both.max(1) + scores[:, i], best)
    out = []
    last = best.argmax(1)
    for c in range(b):
        labels = np.empty(lengths[c], np.int8)
        state = last[c]
        for i in range(lengths[c] - 1, -1, -1):
            labels[i] = state
            state = came[c, i, state]
        out.append(labels)
    return out


def skip_words(key: str, common: frozenset[str]) -> tuple[str, str]:
    """The word and the stem by which a token is joined with others, letter case aside: common words, single characters and punctuation by none, short words by no stem."""
    low = key.strip(" \t" + _HIDDEN + _STRANGE).lower()
    if len(low) < 2 or not (low[0].isalnum() or low[0] == "_") or low in common:
        return "", ""
    return low, low[:5] if len(low) >= 5 else ""


def skip_edges(words: np.ndarray, stems: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(token, token, sort) of successive places in a text of equal words (0) and of other words of one stem (1); number 0 is no word or stem.

    At most two edges per token, however often it stands.
    """
    out = []
    for sort, of in enumerate((words, stems)):
        at = np.flatnonzero(of)
        at = at[np.lexsort((at, text[at], of[at]))]
        a, b = at[:-1], at[1:]
        on = (of[a] == of[b]) & (text[a] == text[b])
        if sort:
            on &= words[a] != words[b]
        out.append(np.stack([a[on], b[on], np.full(on.sum(), sort)], 1))
    return np.concatenate(out)


class Lattice:
    """Chains of texts one after the other, cut down, without loss, to the regions that can hold details.

    A token is left out if no run of tokens around it, whatever its labels, transitions and messages,
    can score above the same run labelled O: then the best labelling has O there. For messages
    such tokens count as O.
    """

    def __init__(self, scores: np.ndarray, pad: np.ndarray, edges: np.ndarray, model: Model) -> None:
        step = model.step
        self.model, self.scores = model, scores
        inner = step.copy()
        inner[inner <= -15] = -np.inf
        into, out_of = float(inner[:, 1:].max() - step[0, 0]), float(inner[1:, 0].max() - step[0, 0])
        u = (scores[:, 1:].max(1) - scores[:, 0]).astype(np.float64) + into
        # the most that a message can speak for a detail
        helps = np.maximum(0, (model.skip[:, :, 1:] - model.skip[:, :, :1]).max((1, 2)))
        for end in (0, 1):
            np.add.at(u, edges[:, end], helps[edges[:, 2]])
        u[pad] = -1e4
        ending = np.cumsum(u)
        ending -= np.minimum.accumulate(np.concatenate([[0.0], ending[:-1]]))
        back = u[::-1]
        starting = np.cumsum(back)
        starting -= np.minimum.accumulate(np.concatenate([[0.0], starting[:-1]]))
        self.active = (ending + starting[::-1] - u + max(0.0, out_of) > 0) & ~pad
        edge = np.diff(np.concatenate([[0], self.active.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        order = np.argsort(b - a, kind="stable")
        self.first, self.length = a[order], (b - a)[order]
        # borders are O on both sides unless the text ends there
        n = len(scores)
        self.bias = np.zeros_like(scores)
        left, right = self.first[(self.first > 0) & ~pad[np.maximum(self.first - 1, 0)]], (self.first + self.length)[(self.first + self.length < n) & ~pad[np.minimum(self.first + self.length, n - 1)]] - 1
        self.bias[left] += step[0]
        self.bias[right] += step[:, 0]
        self.edges = edges[self.active[edges[:, 0]] | self.active[edges[:, 1]]] if len(edges) else edges
        self.messages = np.zeros((2 * len(self.edges), N_KINDS), np.float32)

    def _groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, padded to the longest; which of them count; lengths) of regions of about one length."""
        i = 0
        while i < len(self.first):
            j = int(np.searchsorted(self.length, max(self.length[i] * 1.5, 8), "right"))
            j = min(j, i + max(1, 200_000 // int(self.length[j - 1])))
            size = self.length[i:j]
            at = self.first[i:j, None] + np.arange(size.max())[None, :]
            yield np.minimum(at, len(self.scores) - 1), np.arange(size.max())[None, :] < size[:, None], size
            i = j

    def _total(self) -> np.ndarray:
        total = self.scores + self.bias
        if len(self.edges):
            # message 2n goes to the second token of edge n, message 2n + 1 to its first
            np.add.at(total, self.edges[:, 1], self.messages[0::2][:, _KIND])
            np.add.at(total, self.edges[:, 0], self.messages[1::2][:, _KIND])
        return total

    def _beliefs(self) -> tuple[np.ndarray, np.ndarray]:
        """By directed message: what its sender believes without the receiver's own message, as kinds."""
        kinds = np.zeros((len(self.scores), N_KINDS), np.float32)
        kinds[:, 0] = 1
        total = self._total()
        for at, on, size in self._groups():
            p, _, _ = marginals(total[at], self.model.step, size)
            kinds[at[on]] = p[on] @ _BY_KIND
        told = self.messages
        out = []
        for sender, back in ((self.edges[:, 0], told[1::2]), (self.edges[:, 1], told[0::2])):
            live = self.active[sender][:, None]
            cavity = np.log(np.maximum(kinds[sender], 1e-12)) - np.where(live, back, 0)
            cavity = np.exp(cavity - cavity.max(1, keepdims=True))
            out.append(cavity / cavity.sum(1, keepdims=True))
        return out[0], out[1]

    def pass_messages(self, rounds: int = ROUNDS) -> None:
        if not len(self.edges) or not self.model.skip.any():
            return
        potential = np.exp(self.model.skip)[self.edges[:, 2]]
        for _ in range(rounds):
            a, b = self._beliefs()
            self.messages[0::2] = np.log(np.einsum("nk,nkl->nl", a, potential))
            self.messages[1::2] = np.log(np.einsum("nk,nlk->nl", b, potential))
            self.messages -= self.messages[:, :1]

    def pairs(self) -> np.ndarray:
        """(edges, kinds, kinds): beliefs of the kinds at both ends."""
        a, b = self._beliefs()
        p = a[:, :, None] * b[:, None, :] * np.exp(self.model.skip)[self.edges[:, 2]]
        return p / p.sum((1, 2), keepdims=True)

    def labels(self) -> np.ndarray:
        out = np.zeros(len(self.scores), np.int8)
        total = self._total()
        for at, on, size in self._groups():
            for row, found in zip(at, best_labels(total[at], self.model.step, size)):
                out[row[: len(found)]] = found
        return out


_OUTSIDE = "\"'“”‘’<>[]{},;:!?*_`|/-"


def _fixed_ends(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without blanks and punctuation around it."""
    while a < b and (text[a].isspace() or text[a] in _OUTSIDE or text[a] in ").") and not (text[a] == "("):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in _OUTSIDE + "(" or text[b - 1] == ")" and text.count(")", a, b) > text.count("(", a, b)):
        b -= 1
    if text[a : a + 1] == "(" and ")" not in text[a:b]:
        a += 1
    if b > a and text[b - 1] == "." and not re.search(r"(?:\b[^\W\d_]|St|Ave|Rd|Blvd|str)\.$", text[a:b]):
        b -= 1
    return a, b


def decoded(text: str, start: np.ndarray, end: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the labelled pieces of a text, without punctuation at their ends; a name that hasn't two parts is left out."""
    out: list[tuple[int, int, int]] = []
    n = len(labels)
    for i in np.flatnonzero(labels % 2 == 1):
        k = int(labels[i] - 1) // 2
        j = i + 1
        while j < n and labels[j] == labels[i] + 1:
            j += 1
        a, b = _fixed_ends(text, int(start[i]), int(end[j - 1]))
        if k == 4 and len(re.findall(r"[^\W\d_]+", text[a:b])) < 2:
            continue
        if a < b:
            out.append((a, b, k))
    return out


class Texts:
    """Texts one after the other as the model sees them, REACH empty places before, between and after."""

    def __init__(self, texts: Sequence[str], hide=None, marks: Sequence[list[tuple[int, int, int]]] | None = None) -> None:
        """hide(keys, codes), where given, hides words and patterns of a text; marks give gold labels."""
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys: list[list[str]] = []
        codes, gold = [], []
        self.at: list[int] = []
        at = REACH
        for n, text in enumerate(texts):
            keys, start, end = tokens_of(text)
            code = _codes(start, end, labelled_patterns(text))
            if marks is not None:
                gold.append(_codes(start, end, marks[n]))
            if hide:
                keys, code = hide(keys, code)
            self.spans.append((start, end))
            self.keys.append(keys)
            codes.append(code)
            self.at.append(at)
            at += len(keys) + REACH
        self.n = at
        self.codes, self.gold, self.pad = np.zeros(at, np.int8), np.zeros(at, np.int8), np.ones(at, bool)
        for a, code in zip(self.at, codes):
            self.codes[a : a + len(code)] = code
            self.pad[a : a + len(code)] = False
        for a, g in zip(self.at, gold):
            self.gold[a : a + len(g)] = g

    def edges(self, coder: Coder, ids: np.ndarray) -> np.ndarray:
        text = np.zeros(self.n, np.int64)
        text[self.at[1:]] = 1
        return skip_edges(*coder.joined[:, ids], np.cumsum(text))

    def ids(self, encode) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for a, keys in zip(self.at, self.keys):
            out[a : a + len(keys)] = encode(keys)
        return out


class Finder:
    """Finds personal details with a model."""

    #: Characters of texts that are looked at together, unless one text has more.
    BATCH = 500_000

    def __init__(self, model: Model) -> None:
        self.coder = Coder(model)

    def find(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= self.BATCH):
                size += len(texts[hi])
                hi += 1
            out += self._find(texts[lo:hi])
            lo = hi
        return out

    def _find(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        model = self.coder.model
        self.coder.forget()
        t = Texts(texts)
        ids = t.ids(self.coder.encode)
        lattice = Lattice(self.coder.scores(ids, t.codes), t.pad, t.edges(self.coder, ids), model)
        lattice.pass_messages()
        labels = lattice.labels()
        return [decoded(text, *spans, labels[a : a + len(spans[0])]) if text else [] for text, spans, a in zip(texts, t.spans, t.at)]


_WORD = re.compile(ANY)
_GOES_ON = re.compile(rf"(?:[ ]{INITIAL})?[ ]({ANY})(?![\w@(]|\.\w)")
_COMES_BEFORE = re.compile(rf"(?<![\w@.+-])({ANY}),[ ]$")
_INITIALS = re.compile(rf"(?<![\w.@&])[A-ZÀ-ÖØ-Þ]\.[ ](?=[A-ZÀ-ÖØ-Þ])({ANY})(?![\w@(]|\.\w)")
_MIDDLE = re.compile(rf"[ ]{INITIAL}")


def silver_labels(texts: Sequence[str]) -> tuple[list[list[tuple[int, int, int]]], frozenset[str], frozenset[str]]:
    """What the labelling functions make of texts (patterns, cued names, and given names known from cues with a surname), the given names, and the common words."""
    patterns = [labelled_patterns(t) for t in texts]
    seen: Counter[str] = Counter()
    capital: Counter[str] = Counter()
    for text, marks in zip(texts, patterns):
        bare = text
        for a, b, _ in reversed(marks):
            bare = bare[:a] + " " + bare[b:]
        words = set(re.findall(r"[^\W\d_]+", bare))
        seen.update({w for w in words if w.islower()})
        capital.update({w.lower() for w in words if w[0].isupper()})
    # names are written small now and then, but seldom
    common = {w for w, n in seen.most_common(COMMON) if n >= 3 and 2 * n >= capital[w]} | PLAIN
    given: Counter[str] = Counter()
    family: Counter[str] = Counter()
    together: dict[str, set[str]] = {}
    cued = []
    for text in texts:
        names = []
        for a, b in cued_names(text):
            parts = [p for p in re.split(r"[ ,]+", text[a:b]) if not p.endswith(".")]
            first, last = (parts[-1], parts[0]) if "," in text[a:b] else (parts[0], parts[-1])
            # a given name may look like a common word, its surname then doesn't
            if all(p[0].isupper() for p in parts) and last.lower() not in common and first.lower() not in PLAIN:
                names.append((a, b, first.lower()))
                if len(parts) == 2:
                    given[first.lower()] += 1
                    family[last.lower()] += 1
                    together.setdefault(first.lower(), set()).add(last.lower())
        cued.append(names)
    # a given name stands with several surnames
    known = {w for w, n in given.most_common(GIVEN_NAMES) if len(together[w]) > 1 and n > family[w] and 3 * n >= seen[w]}
    common -= known
    cued = [[(a, b) for a, b, first in names if first not in common] for names in cued]
    firsts = (known | set(GIVEN)) - common
    out = []
    for text, names, marks in zip(texts, cued, patterns):
        extra = []
        for m in _WORD.finditer(text):
            low = m.group().lower()
            before = text[max(0, m.start() - 40) : m.start()]
            if low not in firsts or before[-1:] and (before[-1].isalnum() or before[-1] in "_@.+-/"):
                continue
            upper = m.group()[0].isupper()
            if (x := _COMES_BEFORE.search(before)) and x.group(1).lower() not in common and (x.group(1)[0].isupper() == upper or x.group(1).lower() in family):
                end = m.end()
                if y := _MIDDLE.match(text, end):
                    end = y.end()
                extra.append((m.start() - len(x.group()), end))
            elif (x := _GOES_ON.match(text, m.end())) and x.group(1).lower() not in common and (upper and x.group(1)[0].isupper() or low in known and (x.group(1).lower() in family or not upper and len(x.group(1)) > 3)):
                extra.append((m.start(), x.end(1)))
        for m in _INITIALS.finditer(text):
            if m.group(1).lower() not in common:
                extra.append(m.span())
        taken = Spans(marks)
        for a, b in sorted({*names, *extra}, key=lambda s: s[0] - s[1]):
            taken.add(a, b, 4)
        out.append(taken.all)
    return out, frozenset(known), frozenset(common)


def _renamed(text: str, marks: Sequence[tuple[int, int, int]], maker: Maker) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with other names."""
    out, new, at = "", [], 0
    for a, b, k in marks:
        value = maker.name() if k == 4 else text[a:b]
        out += text[at:a]
        new.append((len(out), len(out) + len(value), k))
        out += value
        at = b
    return out + text[at:], new


def _hider(seed: int, words: float, patterns: float):
    """Hides words, of each text another share up to twice ``words``, and the pattern's marks of a whole text, at random."""
    rng = np.random.default_rng(seed)

    def hide(keys: list[str], codes: np.ndarray) -> tuple[list[str], np.ndarray]:
        off = rng.random(len(keys)) < words * 2 * rng.random()
        strange = rng.random(len(keys)) < 0.35
        if rng.random() < patterns:
            codes = np.zeros_like(codes)
        return [(_STRANGE if s and k.strip()[0].islower() else _HIDDEN) + k if h and k[-1].isalpha() else k for k, h, s in zip(keys, off, strange)], codes

    return hide


class _Batch:
    """Pieces of chains that are trained together, and what their gradients need in order."""

    def __init__(self, t: Texts, ids: np.ndarray, features: np.ndarray, grams: list[np.ndarray], pieces: list[tuple[int, int]]) -> None:
        self.lengths = np.array([n for _, n in pieces])
        width = int(self.lengths.max())
        at = np.array([a for a, _ in pieces])[:, None] + np.arange(width)[None, :]
        self.on = np.arange(width)[None, :] < self.lengths[:, None]
        place = at[self.on]
        self.gold = t.gold[place]
        self.codes = [t.codes[place + o] for o in (-1, 0, 1)]
        self.grams = [g[place] for g in grams]
        self.by_gram = [_runs(g) for g in self.grams]
        around = [ids[place + o] for o in range(-REACH, REACH + 1)]
        used, local = np.unique(np.concatenate(around), return_inverse=True)
        self.around = np.split(local, len(around))
        # sums by word, then by feature, as runs of sorted places
        self.by_word = [_runs(x) for x in self.around]
        self.features = features[used]
        self.n_words = len(used)
        # feature 0 has no weights
        owner = np.repeat(np.arange(self.n_words), N_FEATURES)
        flat = self.features.ravel()
        owner, flat = owner[flat > 0], flat[flat > 0]
        order, self.starts, self.rows = _runs(flat)
        self.owner = owner[order]
        same = np.cumsum(self.lengths)[:-1]
        inner = np.ones(len(place), bool)
        inner[0] = False
        inner[same] = False
        self.steps = np.flatnonzero(inner)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(x, kind="stable")
    values, starts = np.unique(x[order], return_index=True)
    return order, starts, values


def _pieces(t: Texts) -> list[tuple[int, int]]:
    """Where chains are cut for training: at line ends, or else after PIECE tokens outside details."""
    out = []
    for a, keys in zip(t.at, t.keys):
        lo = 0
        while lo < len(keys):
            hi = min(len(keys), lo + PIECE)
            if hi < len(keys):
                ok = [i for i in range(hi, lo + PIECE // 2, -1) if not t.gold[a + i] or t.gold[a + i] % 2]
                hi = next((i for i in ok if keys[i - 1].endswith("\n")), ok[0] if ok else hi)
            out.append((a + lo, hi - lo))
            lo = hi
    return out


def train(parts: Sequence[Texts], given: frozenset[str], common: frozenset[str], epochs: int = 10, batch_tokens: int = 4_000, rate: float = 0.25, seed: int = 0) -> Model:
    """Fit the chain by the gradient of its likelihood (AdaGrad)."""
    vocabulary: dict[str, int] = {"": 0}
    ids = [t.ids(lambda keys: [vocabulary.setdefault(k, len(vocabulary)) for k in keys]) for t in parts]
    counts: Counter[str] = Counter()
    for k, n in zip(list(vocabulary)[1:], np.bincount(np.concatenate(ids), minlength=len(vocabulary))[1:].tolist()):
        for f in token_features(k, given, common):
            counts[f] += n
    model = Model.empty(given, common, {f: i for i, (f, n) in enumerate(counts.most_common(FEATURES), 1) if n > 1})
    features = np.array([[0] * N_FEATURES, *[model.numbers(k) for k in vocabulary if k]])
    classes = np.array([0, *[token_class(k, given, common) for k in vocabulary if k]])
    batches = []
    for t, x in zip(parts, ids):
        grams = _grams(classes[x])
        now, longest = [], 0
        for piece in sorted(_pieces(t), key=lambda p: p[1]):
            longest = max(longest, piece[1])
            now.append(piece)
            if longest * len(now) >= batch_tokens:
                batches.append(_Batch(t, x, features, grams, now))
                now, longest = [], 0
        if now:
            batches.append(_Batch(t, x, features, grams, now))
    rng = np.random.default_rng(seed)
    squares = [np.full_like(p, 1e-2) for p in (model.token, model.pattern, model.step, model.gram)]
    barred = _allowed() < 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            table = model.token[:, b.features].sum(2)
            flat = sum(model.pattern[o][b.codes[o]] for o in range(3))
            for gram, at in zip(model.gram, b.grams):
                flat += gram[at]
            for o, words in enumerate(b.around):
                flat += table[o, words]
            scores = np.zeros((*b.on.shape, N_LABELS), np.float32)
            scores[b.on] = flat
            p, moves, _ = marginals(scores, model.step, b.lengths)
            g = -p[b.on]
            g[np.arange(len(g)), b.gold] += 1
            grad_step = -moves.astype(np.float32)
            np.add.at(grad_step, (b.gold[b.steps - 1], b.gold[b.steps]), 1)
            grad_step[barred] = 0
            grad_pattern = np.zeros_like(model.pattern)
            for o in range(3):
                np.add.at(grad_pattern[o], b.codes[o], g)
            grad_table = np.zeros((len(b.around), b.n_words, N_LABELS), np.float32)
            for o, (order, starts, values) in enumerate(b.by_word):
                grad_table[o, values] = np.add.reduceat(g[order], starts)
            grad_token = np.add.reduceat(grad_table[:, b.owner], b.starts, axis=1)
            updates = [(model.token, grad_token, squares[0], (slice(None), b.rows)), (model.pattern, grad_pattern, squares[1], ...), (model.step, grad_step, squares[2], ...)]
            updates += [(model.gram[o], np.add.reduceat(g[order], starts), squares[3][o], values) for o, (order, starts, values) in enumerate(b.by_gram)]
            for x, grad, q, on in updates:
                now = x[on]
                grad -= 2e-5 * np.where(np.abs(now) < 20, now, 0) * len(g) / 1000
                q[on] += grad * grad
                x[on] = now + rate * grad / np.sqrt(q[on])
    return model


def train_skips(model: Model, parts: Sequence[Texts], epochs: int = 6, rate: float = 0.3) -> np.ndarray:
    """Fit the potentials of the skip edges to texts the chain hasn't seen, by the gradient of their likelihood; expectations are those of loopy message passing."""
    coder = Coder(model)
    model = replace(model, skip=np.zeros((2, N_KINDS, N_KINDS), np.float32))
    ids = [t.ids(coder.encode) for t in parts]
    seen = [(coder.scores(x, t.codes), t.edges(coder, x)) for t, x in zip(parts, ids)]
    square = np.full_like(model.skip, 1e-2)
    for _ in range(epochs):
        for t, (s, edges) in zip(parts, seen):
            lattice = Lattice(s, t.pad, edges, model)
            if not len(lattice.edges):
                continue
            lattice.pass_messages()
            believed = lattice.pairs()
            grad = np.zeros_like(model.skip)
            kinds = _KIND[t.gold]
            for n in (0, 1):
                on = lattice.edges[:, 2] == n
                np.add.at(grad[n], (kinds[lattice.edges[on, 0]], kinds[lattice.edges[on, 1]]), 1)
                grad[n] -= believed[on].sum(0)
            grad += grad.transpose(0, 2, 1)
            grad -= 0.02 * model.skip
            square += grad * grad
            model.skip = model.skip + rate * grad / np.sqrt(square)
    return model.skip.astype(np.float32)


def f1(found: Sequence[list], marks: Sequence[list]) -> float:
    """Agreement of spans."""
    a = sum(len(set(f) & set(map(tuple, m))) for f, m in zip(found, marks))
    return 2 * a / max(1, sum(map(len, found)) + sum(map(len, marks)))


def fit_texts(texts: Sequence[str], repos: Sequence[str], made: int = MADE) -> Model:
    """Train on texts; those of about an eighth of the repositories, and made texts of their lines, teach the skip edges only."""
    if not texts:
        return Model.empty()
    marks, given, common = silver_labels(texts)
    held = [zlib.crc32(r.encode()) % 8 == 0 for r in repos]
    maker = Maker()
    lines: tuple[list[str], list[str]] = ([], [])
    for text, m, h in zip(texts, marks, held):
        if not m:
            lines[h].extend(x.strip() for x in text.splitlines() if 0 < len(x.strip()) < 200)
    words = sorted(w for w in common if len(w) > 1)
    keep = lambda h: [(t, m) for t, m, x in zip(texts, marks, held) if x == h and (m or zlib.crc32(t.encode("utf-8", "replace")) % 8 == 0)]
    real = keep(False)  # most texts hold nothing; an eighth of those is enough to learn what isn't meant
    other = [_renamed(t, m, maker) for t, m in real if any(k == 4 for *_, k in m)]
    invented = [maker.example(lines[0], words) for _ in range(made)]
    sets = [(real, None), (other, _hider(1, 0.3, 0.2)), (invented, _hider(2, 0.45, 0.5))]
    parts = [Texts([t for t, _ in x], hide, [m for _, m in x]) for x, hide in sets if x]
    model = train(parts, given, common)
    unseen = [maker.example(lines[1] or lines[0], words) for _ in range(made // 3)]
    blocks = [(keep(True), None), (unseen, _hider(3, 0.4, 0.5))]
    model.skip = train_skips(model, [Texts([t for t, _ in x[i : i + 200]], hide, [m for _, m in x[i : i + 200]]) for x, hide in blocks for i in range(0, len(x), 200)])
    return model


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` texts, drawn by the hash of their id whatever they hold.

    Without texts the model finds nothing.
    """
    rows = draw(documents.where(F.length("text").between(1, LONGEST)).select("doc_id", F.coalesce("repo", F.lit("")).alias("repo"), "text"), sample, "doc_id", rows=documents.count())
    return fit_texts([r["text"] for r in rows], [r["repo"] for r in rows])


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    finder = Finder(model)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, kinds, values = [], [], []
            for i, text, spans in zip(part.column(0).to_pylist(), texts, finder.find(texts)):
                for k, v in sorted({(k, text[a:b]) for a, b, k in spans}):
                    ids.append(i)
                    kinds.append(KINDS[k])
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["doc_id", "kind", "value"])


def _replaced(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    finder = Finder(model)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = part.column(1).to_pylist()
            out = []
            for text, spans in zip(texts, finder.find([t or "" for t in texts])):
                for a, b, k in sorted(spans, reverse=True):
                    text = f"{text[:a]}[{KINDS[k].upper()}]{text[b:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def personal_details(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind, value): a row per distinct value of a kind in a document.

    Null and empty texts have no row. Repeated rows of a document give
    repeated rows. The model is sent to the tasks: its size is fixed.
    """
    model = model or fit(documents)
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(lambda it: _found(it, model), "doc_id bigint, kind string, value string")


def redacted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text): every text with each detail replaced by a placeholder of its kind, [EMAIL] for one, all else as it was; null texts stay null."""
    model = model or fit(documents)
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(lambda it: _replaced(it, model), "doc_id bigint, text string")
