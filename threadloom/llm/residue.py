"""Template residue and error-page text in place of content.

Texts are cut into segments (lines and sentences, speaker labels taken off; placeholders with a few
words on either side). A regularised linear classifier on hashed word n-grams, token shapes, length
and title features decides on every segment of every document: residue is what scores at least the
threshold, nothing else is asked. It learns from weak labels: response statuses, stock phrases,
placeholders and filler standing alone are positive, the same words inside reported speech and
everything without them negative, the rest unlabelled.

Training reads every labelled segment of every document, whatever the number. The segments are cut
and hashed once into packed blocks (``packed``); the classifier that is used and those of the folds
are fitted together by full gradients, a round being one pass over the blocks on all executors. The
threshold is the one with the best F1 over all labelled segments, each scored by a classifier that saw
no segment of its source. Gradients are summed as whole numbers, so that neither order nor partitions
change the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.durable import cut, drop_cut, spread

BITS = 17
FOLDS = 3
#: Segments of a packed block, which are scored at once.
BATCH = 20_000
#: Passes over all segments that the fits make, and the differences of gradients that they keep.
ROUNDS = 8
MEMORY = 8
L2 = 1e-6
#: Of the first step, as features that stand together all move.
FIRST_STEP = 0.1
#: Partitions whose sums the driver adds up itself.
DIRECT = 32
PLATEAU = 0.002
#: Threshold where no source is left to choose one on.
DEFAULT_THRESHOLD = 0.5

# Placeholder notations of template languages and forms.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|<%[^%\n]+%>|\{%[^%\n]+%\}|%%[\w.]{2,}%%|@@[\w.]{2,}@@|\[\[[^\[\]\n]+\]\]|<<[\w. ]{2,}>>|"
    r"__[A-Z][A-Z_.]+__|(?<![\w#])#[A-Za-z_][\w.]+#(?![\w#])|%\([a-z_]\w*\)s|\{[A-Za-z_][\w.]+\}|"
    r"<(?i:insert|enter|your|add|fill)\b[^<>\n]*>|\[(?i:insert|enter|your|add|fill)\b[^\[\]\n]*\]|\[[^\[\]\n]{2,}(?i: to be (?:added|inserted|completed|confirmed)| here| tbc| tbd)\]"
)

# Statuses and phrases that servers, browsers and page templates show.
_STATUS = r"(?:http|status|error|erreur|fehler|code)\s*:?\s*[45]\d\d\b|[45]\d\d\s*[-:|]?\s+(?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway time-?out|unauthorized|bad request|too many requests)"
_SCRIPTS = r"java\s?script|script(?:s|ing)?\b(?! of\b)|noscript|cookies"
_TURN_ON = r"enabl\w+|allow\w*|activat\w+|switch(?:ed)? (?:on|off)|turn(?:ed)? (?:on|off)|unblock\w*|disabled|required|needs?|does not run|aktivier\w+|einschalten|activer|activez|autoris\w+"
_FAILURE = (
    r"access (?:is |was )?denied|permission denied|not have permission|page not found|(?:could|can) ?not (?:be )?(?:found|find|be shown|be loaded|load|fetch)|failed to load|"
    r"(?:connection|read|write|query|lookup|download|upload|gateway|request|server|upstream)(?: \w+)? (?:refused|time-?out|reset|failed|did not respond)|timed out|timeout after|too many requests|session (?:has )?expired|"
    r"(?:unexpected|internal|unknown) error|error (?:has )?occurred|something went wrong|try again|permission denied|temporarily (?:offline|unavailable)|momentanément indisponible|"
    r"does not exist|is undefined|is not defined|unavailable|log in again|sign in again|address was blocked|go back to the start page|not at this address|seite nicht gefunden|page introuvable|"
    r"wurde verschoben|was moved|is restricted|is busy|bad gateway|traceback|exception in|stack trace"
)
_FILLER = r"dummy (?:entry|text)|sample (?:speech|text)|text to follow|to be supplied|texte à venir|hier steht später|replace this paragraph|blindtext|platzhalter|faux[- ]texte|insert name here|lorem ipsum|content goes here"
_ALONE = r"(?:tbd|tba|tbc|todo|n/a|xxx+|null|undefined|nan)"
_WORD_ALONE = re.compile(rf"(?i)\W*{_ALONE}\W*$")
TRIGGER = re.compile(rf"(?i)\b(?:{_STATUS})|\b(?:{_FAILURE})|{_FILLER}|(?:{_TURN_ON})\W.*?(?:{_SCRIPTS})|(?:{_SCRIPTS})\W.*?(?:{_TURN_ON})|^\W*{_ALONE}\W*$")
#: Words of reported speech: who speaks of such a text does not show it.
REPORTED = re.compile(
    r"(?i)\b(?:said|says|told|tells?|asks? for|answered|answers|quotes?|quoted|showed|shows me|greets|wrote to|(?<!to )reads?(?! timed| reset| error)|exists|went to print|screen that|with the words|"
    r"was written|were required by|as if|laughed|voting|ballot|message|sagt\w*|las|dit|disait|affich\w+|meldet\w*|zeigt\w*)\b"
)
# Words of the usual dummy Latin.
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor magna aliqua nulla quis velit nibh mollis fusce sapien".split())
# Parts, lower case, one of which every match of TRIGGER but those of _ALONE holds.
_HINTS = (
    "script", "cookie", "denied", "have permission", "not found", "not find", "not load", "not fetch", "not be ", "refused", "timed out", "timeout", "time-out", "reset", "failed", "not respond",
    "requests", "expired", "error", "erreur", "fehler", "went wrong", "try again", "offline", "unavailable", "indisponible", "not exist", "undefined", "not defined", "log in", "sign in", "blocked",
    "start page", "address", "introuvable", "verschoben", "moved", "restricted", "busy", "gateway", "traceback", "exception", "stack trace", "dummy", "sample", "to follow", "supplied", "venir",
    "später", "paragraph", "blindtext", "platzhalter", "faux-texte", "faux texte", "insert name", "ipsum", "content goes", "http", "status", "code", "forbidden", "unauthorized", "bad request",
)
_MARK = re.compile(r"[{<%@\[_#$]")
_LABEL_WORD = r"(?:[A-ZÀ-ÖØ-ÞŁŽ][\w.'’-]*|\([^()\n]+\)|on behalf of the|group|de|von|der)"
_LABEL = re.compile(rf"^{_LABEL_WORD}(?:,?\s+{_LABEL_WORD}){{0,8}}\s*(?::|\s-|\.\n)\s+(?=\S)")
_SENTENCE_END = re.compile(r"[.!?]\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANK = {i: " " for i in range(128) if not chr(i).isalpha()}
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
_ASCII_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\w\s]+|_+|\n", re.ASCII)
_ONE_LETTER = re.compile(r"(?i)[\W\d_]*([^\W\d_])\1*(?![^\W\d_])")
_ASIDE = re.compile(r"\((?:[^()\n]+)\)|(?<!\[)\[(?:[^\[\]\n]+)\](?!\])")


def _hints() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in _HINTS:
        found.add_word(word, word)
    found.make_automaton()
    return found


_HINTED = _hints()


def has_placeholder(text: str) -> bool:
    return _MARK.search(text) is not None and PLACEHOLDER.search(text) is not None


def trigger(segment: str) -> bool:
    """Whether a status or stock phrase stands in the segment."""
    return _WORD_ALONE.match(segment) is not None or next(_HINTED.iter(segment.lower()), None) is not None and TRIGGER.search(segment) is not None


def segments(text: str) -> list[str]:
    """The lines and sentences of a text with speaker labels and bracketed asides taken off.

    An aside is taken off unless it holds a placeholder. White space is collapsed. Of a sentence of more
    than six words with placeholders each one is a segment with the three words on either side, lest the sentence
    around it outweigh it.
    """
    plain = _ASIDE.sub(lambda m: m[0] if has_placeholder(m[0]) else " ", text)
    out = []
    for line in plain.split("\n"):
        rest = line.strip()
        label = _LABEL.match(rest)
        if label and not has_placeholder(label[0]) and not trigger(label[0]):
            rest = rest[label.end() :]
        at = 0
        sentences = []
        for end in _SENTENCE_END.finditer(rest):
            sentences.append(rest[at : end.start() + 1])
            at = end.end()
        for s in [*sentences, rest[at:]]:
            words = s.split()
            if not words:
                continue
            s = " ".join(words)
            if len(words) > 6 and has_placeholder(s):
                for m in PLACEHOLDER.finditer(s):
                    out.append(" ".join([*s[: m.start()].split()[-3:], m[0], *s[m.end() :].split()[:3]]))
            else:
                out.append(s)
    return out


def _repeats(words: list[str]) -> bool:
    """Filler made of few words over and over, of keyboard runs or of one letter."""
    if len(words) >= 4 and all(len(set(w)) == 1 for w in words):
        return True
    return len(words) >= 6 and len(set(words)) <= max(2, len(words) // 2) and not any(w in ("the", "die", "la", "le", "und", "et", "and", "of") for w in words)


def weak_label(segment: str) -> int | None:
    """1 residue, 0 content, None where the words do not tell."""
    if has_placeholder(segment):
        return 0 if re.search(r"(?i)\b(?:asks? for|brackets)\b", segment) else 1
    words = segment.lower().translate(_BLANK).split() if segment.isascii() else _LETTERS.findall(segment.lower())
    if len(words) >= 5 and 2 * sum(w in _LATIN for w in words) >= len(words) or _repeats(words):
        return 1
    if trigger(segment):
        if len(words) >= 8 and REPORTED.search(segment):
            return 0
        return 1 if len(words) <= 14 else None
    return 0


Item = tuple[str, str | None, bool]
_MASK = (1 << BITS) - 1
#: Stands for no feature.
SKIP = 1 << BITS
SHAPES = 7
_END = 2
_CODES: dict[str, int] = {"\n": _END}
_TITLES: dict[str, np.ndarray] = {}


def _code(token: str) -> int:
    """Hash of a token's form, kept for the usual tokens: numbers by length (and class, if they could
    be a status), runs of one letter as such, all else in lower case. Words are odd, the rest even."""
    low = token.lower()
    if token[0].isdigit():
        form = "#" + str(len(token)) + (token[0] if len(token) == 3 and token[0] in "45" else "")
    else:
        form = "rep" + low[0] if len(low) > 1 and low[0].isalpha() and len(set(low)) == 1 else low
    code = zlib.crc32(form.encode("utf-8", "surrogatepass")) & ~1 | token[0].isalpha()
    if len(_CODES) < 200_000:
        _CODES[token] = code
    return code


_LATIN_CODES = np.sort(np.array([_code(w) for w in _LATIN], np.int64))


def _title_codes(title: str) -> np.ndarray:
    found = _TITLES.get(title)
    if found is None:
        found = np.unique(np.array([_code(w) for w in title.lower().split() if len(w) > 3 and w[0].isalpha()], np.int64))
        if len(_TITLES) < 50_000:
            _TITLES[title] = found
    return found


@dataclass
class Block:
    """Hashed features of some segments in one array: the words and marks of each, closed by ``SKIP``,
    as many pairs of neighbours, and ``SHAPES`` classes (of all segments the first, then the second).
    ``lengths`` are the words of each."""

    index: np.ndarray
    lengths: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """The square root of the number of features undoes a segment's length."""
        return 1 / np.sqrt(2 * self.lengths - 1 + SHAPES)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        n = (len(self.index) - SHAPES * len(self.lengths)) // 2
        if not n:
            return np.zeros(0)
        found = weights[self.index]
        total = np.add.reduceat(found[:n] + found[n : 2 * n], np.cumsum(self.lengths) - self.lengths)
        return bias + (total + found[2 * n :].reshape(SHAPES, -1).sum(0)) * self.scale

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The sum by feature of one value per segment; exact for whole numbers below 2 ** 53."""
        each = np.repeat(values, self.lengths)
        out = np.bincount(self.index, np.concatenate([each, each, np.tile(values, SHAPES)]), SKIP + 1)
        out[SKIP] = 0
        return out


def _block(codes: np.ndarray, lengths: np.ndarray, shapes: np.ndarray) -> Block:
    """The block of the low bits of all codes, segments closed by ``_END``."""
    words = codes.astype(np.int64)
    pairs = (np.r_[_END, words[:-1]] * 1_000_003 ^ words)[: len(words)] & _MASK
    words[np.cumsum(lengths) - 1] = SKIP
    return Block(np.concatenate([words, pairs, shapes.ravel()]), lengths)


def _tokens(texts: list[str]) -> list[str]:
    """The tokens of all texts, a line end after each text."""
    out: list[str] = []
    for s in texts:
        out += (_ASCII_TOKEN if s.isascii() else _TOKEN).findall(s)
        out.append("\n")
    return out


def _doubtful(texts: list[str], codes: np.ndarray, owner: np.ndarray, word: np.ndarray, n_words: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Whether ``weak_label`` of a text may be other than 0: a mark or hint stands in it, or its words are
    few, repeat or are Latin."""
    joined = "\n".join(texts)
    low = joined.lower()
    if len(low) != len(joined):
        return np.ones(len(texts), bool)
    ends = np.cumsum([len(s) + 1 for s in texts])
    places = [m.start() for m in _MARK.finditer(joined)]
    places.extend(at for at, _ in _HINTED.iter(low))
    out = (n_words <= 2) | (n_words >= 6) & (distinct <= np.maximum(2, n_words // 2)) | np.array([_ONE_LETTER.match(s) is not None for s in texts])
    out[np.searchsorted(ends, np.array(places, np.int64), "right")] = True
    latin = word & (_LATIN_CODES[np.searchsorted(_LATIN_CODES, codes) % len(_LATIN_CODES)] == codes)
    return out | (2 * np.bincount(owner[latin], minlength=len(texts)) >= n_words)


def features(items: list[Item]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, shapes) of (segment, title, first of its document), which make a block, and
    whether ``weak_label`` need be asked as it may be other than 0.

    Of shapes there are classes of length, variety of words, first token, place, case and end, words
    shared with the title, and whether a placeholder stands in the segment.
    """
    n = len(items)
    if not n:
        return np.zeros(0, np.int32), _NONE, np.zeros((SHAPES, 0), np.int32), np.zeros(0, bool)
    known = _CODES.get
    codes = np.array([known(t) or _code(t) for t in _tokens([x[0] for x in items])], np.int64)
    end = codes == _END
    owner = np.cumsum(end) - end
    ends = np.flatnonzero(end)
    starts = np.r_[0, ends[:-1] + 1]
    word = (codes & 1 == 1) & ~end
    spoken = np.sort(owner[word] << 32 | codes[word])
    spoken = spoken[np.r_[True, spoken[1:] != spoken[:-1]]] if len(spoken) else spoken
    n_words, distinct = np.bincount(owner[word], minlength=n), np.bincount(spoken >> 32, minlength=n)
    titles = [_title_codes(t) if t else _NONE for _, t, _ in items]
    sizes = np.array([len(t) for t in titles])
    asked = np.repeat(np.arange(n), sizes) << 32 | np.concatenate([_NONE, *titles])
    at = np.searchsorted(spoken, asked)
    at[at == len(spoken)] = 0
    shared = np.bincount(asked[spoken[at] == asked] >> 32, minlength=n) if len(spoken) else np.zeros(n, np.int64)
    style = [s[:1].islower() + 2 * (s[-1:] in ".!?") for s, _, _ in items]
    shapes = np.stack(
        [
            101 + np.minimum(n_words, 30) // 2, 131 + np.rint(4 * distinct / np.maximum(1, n_words)).astype(np.int64), codes[starts] * 31 + 7, 141 + np.array([f for _, _, f in items], np.int64), 151 + np.array(style),
            161 + np.minimum(shared, 2), 171 + np.array([has_placeholder(s) for s, _, _ in items], np.int64),
        ]
    )
    doubtful = _doubtful([x[0] for x in items], codes, owner, word, n_words, distinct)
    return (codes & _MASK).astype(np.int32), ends - starts + 1, ((shapes * 2_654_435_761 >> 7) & _MASK).astype(np.int32), doubtful


_NONE = np.zeros(0, np.int64)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of the linear classifier, and the score from which a segment is residue."""

    weights: np.ndarray
    bias: float
    threshold: float = DEFAULT_THRESHOLD

    def scores(self, items: list[Item]) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(items), BATCH):
            some = items[at : at + BATCH]
            out.append(_logistic(_block(*features(some)[:3]).margins(self.weights, self.bias)))
        return np.concatenate(out)


class _Descent:
    """Limited-memory quasi-Newton steps for one classifier: ``at`` is the point to try next, ``best`` the
    best so far. Steps are in units of each feature's own curvature, so that rare ones move too."""

    def __init__(self, curvature: np.ndarray) -> None:
        self.unit = 1 / np.sqrt(curvature)
        self.at = self.best = self.grad = self.way = np.zeros(len(curvature))
        self.loss, self.slope, self.step = np.inf, 0.0, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def tell(self, loss: float, grad: np.ndarray) -> None:
        """Take the loss and gradient at ``at``; a point that is no better is tried again nearer by."""
        if loss > self.loss + 1e-4 * self.step * self.slope:
            bend = loss - self.loss - self.step * self.slope
            self.step *= min(0.5, max(0.05, -self.step * self.slope / (2 * bend)))
        else:
            grad = grad * self.unit
            moved, turned = self.step * self.way, grad - self.grad
            if moved @ turned > 1e-12 * (turned @ turned):
                self.pairs = [*self.pairs[-MEMORY + 1 :], (moved, turned)]
            self.best, self.loss, self.grad = self.at, loss, grad
            way, kept = -grad, []
            for moved, turned in reversed(self.pairs):
                kept.append(moved @ way / (moved @ turned))
                way = way - kept[-1] * turned
            if self.pairs:
                moved, turned = self.pairs[-1]
                way = way * (moved @ turned / (turned @ turned))
            for (moved, turned), k in zip(self.pairs, reversed(kept)):
                way = way + (k - turned @ way / (moved @ turned)) * moved
            self.way, self.slope, self.step = way, float(grad @ way), 1.0 if self.pairs else FIRST_STEP
        self.at = self.best + self.step * self.way * self.unit


@dataclass
class Sums:
    """What a pass adds up for classifiers of given weights (a row each, the bias last): a segment of
    fold f and label y (2: none) weighs ``weighs[k, f, y]`` for classifier k. The sums are whole numbers,
    ``1 / unit`` of the real ones, hence the same in any order."""

    weights: np.ndarray
    weighs: np.ndarray
    unit: float
    curvature: bool

    def zero(self) -> np.ndarray:
        return np.zeros((len(self.weights) * (1 + self.curvature), SKIP + 3), np.int64)

    def add(self, total: np.ndarray, block: Block, label: np.ndarray, fold: np.ndarray) -> None:
        """By classifier: the gradient by feature, that of the bias and a 32nd of the loss; after these, if
        asked for, the greatest second derivatives by feature and of the bias."""
        scale = block.scale
        for k, w in enumerate(self.weights):
            weigh = self.weighs[k, fold, label] * self.unit
            if self.curvature:
                total[k - len(self.weights), :-2] += block.spread(np.rint(weigh / 4 * scale * scale)).astype(np.int64)
                total[k - len(self.weights), -2] += int(np.rint(weigh / 4).sum())
            z = block.margins(w[:-1], w[-1])
            err = (_logistic(z) - (label == 1)) * weigh
            total[k, :-2] += block.spread(np.rint(err * scale)).astype(np.int64)
            total[k, -2] += int(np.rint(err).sum())
            total[k, -1] += int(np.rint(np.logaddexp(0, np.where(label == 1, -z, z)) * weigh / 32).sum())


def _descend(counts: np.ndarray, uses: np.ndarray, sums: Callable[[Sums], np.ndarray], rounds: int, l2: float) -> list[tuple[np.ndarray, float]]:
    """(weights, bias) of classifiers that each learn from the folds that a row of ``uses`` names: logistic
    regression with L2 penalty, both classes weighing the same. ``counts`` has the rows by fold and label,
    ``sums`` goes over all of them. Without a positive nothing is residue."""
    rows = uses @ counts
    # Rows of the rarer class weigh 1 and the others less, so that sums stay below twice its rows.
    least = np.where(rows.min(1) > 0, rows.min(1), rows.max(1))[:, None]
    weighs = np.zeros((*uses.shape, 3))
    weighs[:, :, :2] = uses[:, :, None] * (least / np.maximum(1, rows))[:, None, :]
    whole = np.maximum(1, 2 * least)
    unit = 2.0 ** min(34, 60 - int(np.ceil(np.log2(whole.max()))))
    weights = np.zeros((len(uses), SKIP + 2))
    if counts[:, 1].any():
        at = weights
        got = sums(Sums(at, weighs, unit, True))
        descents = [_Descent(x + l2) for x in got[len(uses) :, :-1] / unit / whole]
        for n in range(rounds):
            got = sums(Sums(at, weighs, unit, False)) if n else got[: len(uses)]
            for x, w, g in zip(descents, at, got / unit / whole):
                bare = np.r_[w[:-1], 0.0]
                x.tell(32 * g[-1] + l2 / 2 * (bare @ bare), g[:-1] + l2 * bare)
            at = np.stack([x.at for x in descents])
        weights = np.stack([x.best for x in descents])
    return [(w[:-1], float(w[-1])) if n else (0 * w[:-1], -30.0) for w, n in zip(weights, rows[:, 1])]


def fit(items: list[Item], labels: list[int], rounds: int = ROUNDS, l2: float = L2) -> Model:
    """The classifier of rows in memory, fitted as ``learn`` does."""
    blocks = []
    for at in range(0, len(items), BATCH):
        label = np.array(labels[at : at + BATCH], np.int64)
        blocks.append((_block(*features(items[at : at + BATCH])[:3]), label, 0 * label))

    def sums(one: Sums) -> np.ndarray:
        total = one.zero()
        for block in blocks:
            one.add(total, *block)
        return total

    counts = np.bincount(np.array(labels, np.int64), minlength=2).astype(float)[None]
    return Model(*_descend(counts, np.ones((1, 1)), sums, rounds, l2)[0])


_PACKED_SHAPE = "names array<string>, negative array<bigint>, positive array<bigint>, host binary, doc_id binary, label binary, codes binary, lengths binary, shapes binary"
_KINDS = {"host": np.int32, "doc_id": np.int64, "label": np.int8, "codes": np.int32, "lengths": np.int32, "shapes": np.int32}


def packed(documents: DataFrame) -> DataFrame:
    """All segments of all documents with an id, in blocks of at most ``BATCH``: names of the hosts (the
    sources) with their numbers of negative and positive segments, and by segment the place of the host
    among the names, doc_id, label (2 where unlabelled) and features, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        hosts: list[str] = []
        items: list[Item] = []

        def block() -> pa.RecordBatch:
            names, host = np.unique(np.array(hosts, object), return_inverse=True)
            codes, lengths, shapes, doubtful = features(items)
            label = np.zeros(len(items), np.int8)
            for i in np.flatnonzero(doubtful):
                y = weak_label(items[i][0])
                label[i] = 2 if y is None else y
            by = [np.bincount(host[label == y], minlength=len(names)).tolist() for y in (0, 1)]
            out = {"host": host, "doc_id": np.array(ids, np.int64), "label": label, "codes": codes, "lengths": lengths, "shapes": shapes}
            for kept in (ids, hosts, items):
                kept.clear()
            bare = [[_squeeze(v.astype(_KINDS[k]))] for k, v in out.items()]
            return pa.RecordBatch.from_arrays([pa.array([list(names)], pa.list_(pa.string())), *(pa.array([x], pa.list_(pa.int64())) for x in by), *(pa.array(x, pa.binary()) for x in bare)], names=[x.split()[0] for x in _PACKED_SHAPE.split(", ")])

        for batch in batches:
            for doc_id, host, title, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for n, s in enumerate(segments(text)):
                    ids.append(doc_id)
                    hosts.append(host)
                    items.append((s, title, n == 0))
                    if len(items) == BATCH:
                        yield block()
        if items:
            yield block()

    host = F.regexp_replace(F.lower(F.trim(F.coalesce("source", F.lit("")))), r"[\s_]+", "_")
    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), host.alias("host"), F.col("agenda_item").alias("title"), "text")
    return spread(src.where("text is not null and doc_id is not null")).mapInArrow(run, _PACKED_SHAPE)


def _squeeze(values: np.ndarray) -> bytes:
    """The size, and the compressed bytes."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd"), kind)


def _over(blocks: DataFrame, columns: list[str], run: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """``run`` over (names, features, columns) of every block, in few partitions, as each gives one sum."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for names, codes, lengths, shapes, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                features = _block(_unsqueeze(codes, np.int32), _unsqueeze(lengths, np.int32).astype(np.int64), _unsqueeze(shapes, np.int32))
                yield names, features, *(_unsqueeze(x, _KINDS[c]).astype(np.int64) for c, x in zip(columns, rest))

    few = 3 * blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.select("names", "codes", "lengths", "shapes", *columns).coalesce(few).mapInArrow(lambda batches: run(opened(batches)), shape)


def _total(parts: DataFrame) -> np.ndarray:
    """The sum of all arrays in the column ``sums``; of many the executors make one of each group first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = _unsqueeze(x, np.int64) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_squeeze(total)], pa.binary())], names=["sums"])

    n = parts.rdd.getNumPartitions()
    if n > DIRECT:
        parts = parts.repartition(max(1, round(n**0.5))).mapInArrow(add, "sums binary")
    return sum((_unsqueeze(bytes(r["sums"]), np.int64) for r in parts.collect()), np.zeros(1, np.int64))


def _folds(counts: dict[str, tuple[int, int]], folds: int) -> dict[str, int]:
    """Sources dealt to folds by their number of positives, so that each fold leaves some to learn from."""
    ranked = sorted(counts, key=lambda h: (-counts[h][1], h))
    return {h: i % folds for i, h in enumerate(ranked)}


@dataclass
class Training:
    """A classifier with its threshold, the counts by (host, label, score in hundredths) of classifiers
    that never saw the host, and all segments in blocks."""

    model: Model
    counts: list[tuple[str, int, int, int]]
    blocks: DataFrame


def learn(documents: DataFrame, folds: int = FOLDS) -> Training:
    """Fit on all labelled segments and choose the threshold on sources that the scoring fit left out.

    The result depends on neither order nor partitions. Documents without id are left out. The caller
    drops the blocks.
    """
    spark = documents.sparkSession
    blocks = cut(packed(documents), "segments")
    per_host = blocks.select(F.inline(F.arrays_zip("names", "negative", "positive"))).groupBy("names").agg(F.sum("negative"), F.sum("positive"))
    by_host = {h: (a, b) for h, a, b in per_host.collect()}
    fold_of = _folds(by_host, folds)
    counts = np.zeros((folds, 2))
    for h, n in by_host.items():
        counts[fold_of[h]] += n

    def sums(one: Sums) -> np.ndarray:
        held = spark.sparkContext.broadcast((one, fold_of))  # 2 ** BITS weights a classifier

        def run(opened: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            one, fold_of = held.value
            total = one.zero()  # of 2 ** BITS features a classifier
            for names, block, host, label in opened:
                one.add(total, block, label, np.array([fold_of[h] for h in names])[host])
            yield pa.RecordBatch.from_arrays([pa.array([_squeeze(total)], pa.binary())], names=["sums"])

        total = _total(_over(blocks, ["host", "label"], run, "sums binary"))
        held.destroy()
        return total.reshape(one.zero().shape)

    uses = np.array([[float(f != k) for f in range(folds)] for k in range(folds + 1)])
    models = [Model(*x) for x in _descend(counts, uses, sums, ROUNDS, L2)]
    held = spark.sparkContext.broadcast((models, fold_of))

    def judge(opened: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        models, fold_of = held.value
        for names, block, host, label in opened:
            fold = np.array([fold_of[h] for h in names])[host]
            score = np.choose(fold, [_logistic(block.margins(m.weights, m.bias)) for m in models[:folds]])
            kinds, n = np.unique(np.stack([host, label, np.floor(score * 100).astype(np.int64)])[:, label < 2], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[h] for h in kinds[0]], pa.string()), *(pa.array(x, pa.int64()) for x in (kinds[1], kinds[2], n))], names=["host", "label", "hundredths", "n"])

    judged = _over(blocks, ["host", "label"], judge, "host string, label bigint, hundredths bigint, n bigint")
    judged_counts = [tuple(r) for r in judged.groupBy("host", "label", "hundredths").agg(F.sum("n").alias("n")).collect()]
    return Training(replace(models[folds], threshold=best_threshold(judged_counts)), judged_counts, blocks)


def best_threshold(counts: list[tuple[str, int, int, int]]) -> float:
    """The middle of the thresholds whose F1 over all (host, label, score in hundredths, n) is within
    ``PLATEAU`` of the best, as single rows tell little there."""
    right, wrong = np.zeros(101), np.zeros(101)
    for _, label, score, n in counts:
        (right if label else wrong)[score] += n
    if not right.any():
        return DEFAULT_THRESHOLD
    tp, fp = right[::-1].cumsum()[::-1], wrong[::-1].cumsum()[::-1]
    f1 = 2 * tp / (tp + fp + right.sum())
    best = np.flatnonzero(f1[1:100] >= f1[1:100].max() - PLATEAU) + 1
    return float(best[len(best) // 2]) / 100


def train(documents: DataFrame) -> Model:
    """The classifier with its threshold."""
    learned = learn(documents)
    drop_cut(learned.blocks)
    return learned.model


def validation(documents: DataFrame) -> list[tuple[str, int, int, int, int]]:
    """(host, true positives, false positives, false negatives, true negatives) per source against the
    weak labels, each judged at the threshold in use by a classifier that saw no segment of it."""
    learned = learn(documents)
    drop_cut(learned.blocks)
    least = round(learned.model.threshold * 100)
    out: dict[str, list[int]] = {}
    for host, label, score, n in learned.counts:
        out.setdefault(host, [0, 0, 0, 0])[(0 if label else 1) if score >= least else (2 if label else 3)] += n
    return [(h, *v) for h, v in sorted(out.items())]


def found(documents: DataFrame) -> DataFrame:
    """doc_id of every document that ``residue`` finds a segment in with the classifier of all of them,
    once; texts are cut and hashed only for the training."""
    learned = learn(documents)
    held = documents.sparkSession.sparkContext.broadcast(learned.model)

    def run(opened: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for _, block, doc_id in opened:
            ids = np.unique(doc_id[_logistic(block.margins(model.weights, model.bias)) >= model.threshold])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["doc_id"])

    ids = cut(_over(learned.blocks, ["doc_id"], run, "doc_id bigint").distinct(), "residue")
    drop_cut(learned.blocks)
    return ids


def residue(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, segment, score) of every residue segment.

    Null and empty texts have none; whole texts are scanned; repeated rows repeat their segments.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights and two, 1 MiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            owners: list[int] = []
            items: list[Item] = []
            rows = []

            def judge() -> None:
                score = model.scores(items)
                rows.extend((owners[i], items[i][0], float(score[i])) for i in np.flatnonzero(score >= model.threshold))  # noqa: B023
                owners.clear()  # noqa: B023
                items.clear()  # noqa: B023

            for doc_id, title, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for n, s in enumerate(segments(text)):
                    owners.append(doc_id)
                    items.append((s, title, n == 0))
                if len(items) >= BATCH:
                    judge()
            judge()
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["doc_id", "segment", "score"])

    src = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("agenda_item").alias("title"), "text")
    return spread(src).mapInArrow(run, "doc_id bigint, segment string, score double")
