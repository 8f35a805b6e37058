"""Secrets by a linear-chain conditional random field.

The field tags every token of every line as begin, inside or outside of a secret from its shape,
its neighbours and features of the file; Viterbi finds the best tags.  It is trained on a bounded
sample of the corpus, labelled by the base patterns, and adds what they miss.  The sample holds the
tokens around numbers and telling words and whole lines of some documents.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of, worker_cache
from .ordinal_quality import minimise

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "tagged")
SAMPLE_DOCUMENTS = 8000  # those with the least hash of their id
PLAIN_ONE_IN, PLAIN_TOKENS = 128, 64  # training only: one sampled document in so many gives all its lines, in pieces
CHUNK_CHARS = 2_000_000  # of texts tagged together
CACHED_TOKENS = 200_000
HASH_BITS = 15
AROUND = 4  # tokens to each side of a telling token
CUE_REACH = 2 * AROUND  # tokens from a cue word to the last token it counts for
LEAST = 8  # characters of a secret
OUT, BEGIN, INSIDE = 0, 1, 2

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]", re.ASCII)
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TELLING = ("pass", "secret", "token", "key", "auth", "cred", "bearer", "akia", *"0123456789")
_IS_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_RUN = bytes([1]) * 32


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in {*_ASSIGNED, *_TELLING}:
        a.add_word(word, word)
    a.make_automaton()
    return a


def hits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of every telling place, ASCII letters in either case."""
    small = text.encode().lower().decode()
    return sorted((last + 1 - len(w), last + 1, w) for last, w in automaton().iter(small))


def matches(text: str, found: list[tuple[int, int, str]]) -> list[tuple[str, re.Match]]:
    """Leftmost non-overlapping matches of each base pattern that are long enough.

    An assignment starts at one of its words and an access key at its mark, so only these places
    are tried; a text without 32 hexadecimal digits in a row is not searched for them.
    """
    out, assign, access = [], 0, 0
    for a, _, w in found:
        if w in _ASSIGNED and a >= assign and (m := ASSIGN.match(text, a)):
            assign = m.end()
            out += [("assign", m)] * (m.end(2) - m.start(2) >= 8)
        elif w == "akia" and a >= access and (m := ACCESS.match(text, a)):
            access = m.end()
            out += [("access", m)] * (m.end() - a >= 16)
    if _RUN in text.encode().translate(_IS_HEX):
        out += [("hex", m) for m in HEX.finditer(text)]
    return out


def windows(text: str, found: list[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """Token spans around telling places, which the field is fitted on; windows that touch are one sequence."""
    out: list[list[tuple[int, int]]] = []
    i = 0
    while i < len(found):
        low, high = text.rfind("\n", 0, found[i][0]) + 1, text.find("\n", found[i][1])
        high = len(text) if high < 0 else high
        tokens = [t.span() for t in _TOKEN.finditer(text, low, high)]
        starts = [a for a, _ in tokens]
        run: list[int] = []
        while i < len(found) and found[i][0] < high:
            at = max(0, bisect_right(starts, found[i][0]) - 1)
            first = max(0, at - AROUND)
            if run and first > run[1]:
                out.append(tokens[run[0] : run[1]])
                run = []
            run = [run[0] if run else first, min(len(tokens), max(at + AROUND + 1, run[1] if run else 0))]
            i += 1
        out.append(tokens[run[0] : run[1]])
    return [w for w in out if w]


_CLASSES = str.maketrans({chr(i): "d" if chr(i).isdigit() else "X" if chr(i).isupper() else "x" for i in range(128) if chr(i).isalnum()})
_REPEATS = re.compile(r"(.)\1+", re.DOTALL)
_LOGS = [0.0] + [i * math.log2(i) for i in range(1, 4096)]


def shape(token: str) -> str:
    token = token[:40]
    if token.isascii():
        kinds = token.translate(_CLASSES)
    else:
        kinds = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token)
    return _REPEATS.sub(r"\1", kinds)[:12]


def form_features(token: str) -> tuple[str, ...]:
    """Features that many tokens share."""
    n = len(token)
    kinds = set(token)
    if len(kinds) == n:
        entropy = math.log2(n)
    else:
        counts = [token.count(c) for c in kinds]
        entropy = math.log2(n) - sum(sorted(_LOGS[c] if c < 4096 else c * math.log2(c) for c in counts)) / n
    digits = sum(map(str.isdigit, token))
    return (
        "s" + shape(token), f"n{min(9, n // 4)}", f"e{int(entropy * 2)}", f"d{min(4, 5 * digits // n)}",
        f"x{n >= 16 and not token.strip('0123456789abcdef')}",
    )


def word_feature(token: str) -> str:
    return "w" + token.lower()[:12] if len(token) < 13 else "w*"


def token_features(token: str) -> list[str]:
    return [*form_features(token), word_feature(token)]


def file_features(text: str) -> list[str]:
    marks = sum(text.count(c) for c in "={};") / max(1, len(text))
    return [f"f{min(5, int(marks * 100))}"]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> (32 - HASH_BITS)


def cue_of(token: str) -> str:
    """The cue a token is for those behind it, or nothing."""
    small = token.lower()
    return small[:12] if 2 < len(small) < 16 and any(w in small for w in _TELLING[:8]) else ""


def slots(tokens: list[str], whole: list[str]) -> np.ndarray:
    """(tokens, features) hash slots: own features, words before and behind, nearest cue, the file's."""
    own = [token_features(t) for t in tokens]
    rows = []
    cue, since = "-", 0
    for i, f in enumerate(own):
        if i - since > CUE_REACH:
            cue = "-"
        before = tokens[i - 1].lower()[:12] if i else "^"
        before2 = tokens[i - 2].lower()[:12] if i > 1 else "^"
        behind = tokens[i + 1].lower()[:12] if i + 1 < len(tokens) else "$"
        row = [*f, "p" + before, "q" + before2, "b" + behind, "c" + cue, "cs" + cue + f[0], *whole]
        rows.append([slot(x) for x in row])
        if here := cue_of(tokens[i]):
            cue, since = here, i
    return np.array(rows, dtype=np.int64)


@dataclass(frozen=True)
class Field:
    emission: np.ndarray  # (slots, 3)
    transition: np.ndarray  # (3, 3) from, to
    first: np.ndarray  # (3,)


def viterbi(field: Field, rows: np.ndarray) -> np.ndarray:
    """Best tags of one sequence."""
    score = field.emission[rows].sum(axis=1)
    back = np.zeros(score.shape, dtype=np.int64)
    best = field.first + score[0]
    for t in range(1, len(score)):
        step = best[:, None] + field.transition
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + score[t]
    tags = np.zeros(len(score), dtype=np.int64)
    tags[-1] = best.argmax()
    for t in range(len(score) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


class Tagger:
    """Best tags of every token of every line, many texts at once.

    A token's share of its own and of its neighbours' scores is worked out once and kept.  A token
    whose score outside leads by more than any change of its two transitions is outside on every best
    path, so lines are cut there without changing a tag; Viterbi runs over all the pieces together.
    """

    def __init__(self, field: Field):
        self.field = field
        self._clear()

    def _clear(self) -> None:
        e = self.field.emission
        # number 0 is the place before and behind a line
        self.numbers: dict[str, int] = {"": 0}
        self.scores = np.zeros((1024, 4, 3))  # own, as the one before, two before, behind
        self.scores[0] = np.stack([np.zeros(3), e[slot("p^")], e[slot("q^")], e[slot("b$")]])
        self.shapes: dict[str, int] = {}
        self.cues: dict[str, int] = {"-": 0}
        self.forms: dict[tuple[str, ...], np.ndarray] = {}
        self.shape_of, self.cue_of = np.zeros(1024, np.int32), np.zeros(1024, np.int32)

    def _add(self, token: str) -> int:
        e, n, f, small = self.field.emission, len(self.numbers), form_features(token), token.lower()[:12]
        if n == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.shape_of = np.concatenate([self.shape_of, np.zeros_like(self.shape_of)])
            self.cue_of = np.concatenate([self.cue_of, np.zeros_like(self.cue_of)])
        form = self.forms.get(f)
        if form is None:
            form = self.forms[f] = e[[slot(x) for x in f]].sum(axis=0)
        at = self.scores[n]
        at[0], at[1], at[2], at[3] = form + e[slot(word_feature(token))], e[slot("p" + small)], e[slot("q" + small)], e[slot("b" + small)]
        self.shape_of[n] = self.shapes.setdefault(f[0], len(self.shapes))
        cue = cue_of(token)
        self.cue_of[n] = self.cues.setdefault(cue, len(self.cues)) if cue else 0
        self.numbers[token] = n
        return n

    def _cue_scores(self, cue: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Scores of the nearest cue, alone and with the token's shape."""
        e, cues, shapes = self.field.emission, list(self.cues), list(self.shapes)
        keys, back = np.unique(cue.astype(np.int64) * len(shapes) + shape, return_inverse=True)
        made = [(cues[k // len(shapes)], shapes[k % len(shapes)]) for k in keys.tolist()]
        return np.array([e[slot("c" + c)] + e[slot("cs" + c + s)] for c, s in made])[back]

    def tags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text and tag of all tokens of ``texts``, in order."""
        if len(self.numbers) > CACHED_TOKENS:
            self._clear()
        ids, sizes, lines = [], [], []
        get, add, cut = self.numbers.get, self._add, _TOKEN.findall
        for text in texts:
            before = len(ids)
            for line in text.split("\n"):
                if tokens := cut(line):
                    lines.append(len(ids))
                    ids += [get(t) or add(t) for t in tokens]
            sizes.append(len(ids) - before)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not ids:
            return owner, np.zeros(0, np.int8)
        opens, ids = np.zeros(len(ids), bool), np.array(ids, dtype=np.int64)
        opens[lines] = True
        n, places = len(ids), np.arange(len(ids))
        line_start = np.maximum.accumulate(np.where(opens, places, 0))
        before, before2, behind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[1:] = np.where(opens[1:], 0, ids[:-1])
        before2[2:] = np.where(places[2:] - line_start[2:] > 1, ids[:-2], 0)
        behind[:-1] = np.where(opens[1:], 0, ids[1:])
        last = np.full(n, -1)
        last[1:] = np.maximum.accumulate(np.where(self.cue_of[ids] > 0, places, -1))[:-1]
        near = (last >= line_start) & (places - last <= CUE_REACH)
        cue = np.where(near, self.cue_of[ids[last]], 0)
        score = self.scores[ids, 0] + self.scores[before, 1] + self.scores[before2, 2] + self.scores[behind, 3]
        score += self._cue_scores(cue, self.shape_of[ids])
        whole = [sum(self.field.emission[slot(f)] for f in file_features(t)) for t in texts]
        score += np.array(whole)[owner]
        return owner, self._best(score, opens)

    def _best(self, score: np.ndarray, opens: np.ndarray) -> np.ndarray:
        move, first = self.field.transition, self.field.first
        slack = 2 * (move.max() - move.min()) + np.where(opens, first.max() - first.min(), 0.0) + 1e-9
        open_ = score[:, OUT] - score[:, 1:].max(axis=1) <= slack
        tags = np.zeros(len(score), np.int8)
        ahead = np.concatenate([[False], open_[:-1]])
        starts = np.flatnonzero(open_ & (opens | ~ahead))
        if not len(starts):
            return tags
        stops = np.concatenate([~open_[1:] | opens[1:], [True]])
        lengths = np.flatnonzero(open_ & stops) + 1 - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # pieces longer than t
        ends = starts + lengths
        best = np.where(opens[starts][:, None], first, move[OUT]) + score[starts]
        back = np.zeros((len(score), 3), np.int8)
        for t in range(1, lengths[0]):
            m = live[t]
            step = best[:m, :, None] + move
            back[starts[:m] + t] = step.argmax(axis=1)
            best[:m] = step.max(axis=1) + score[starts[:m] + t]
        # a piece that ends inside its line is followed by a token outside
        closed = np.concatenate([opens, [True]])[ends]
        tag = (best + np.where(closed[:, None], 0.0, move[:, OUT])).argmax(axis=1)
        tags[ends - 1] = tag
        for t in range(lengths[0] - 1, 0, -1):
            m = live[t]
            tags[starts[:m] + t - 1] = back[starts[:m] + t, tags[starts[:m] + t]]
        return tags


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_sequences(rows: list[np.ndarray], tags: list[np.ndarray], rounds: int = 60, l2: float = 1e-3) -> Field:
    """Maximum penalised likelihood; forward and backward sums run over all sequences at once.

    With no sequences, or no secret among them, every token is outside.
    """
    size = 1 << HASH_BITS
    if not rows or not any((t == BEGIN).any() for t in tags):
        return Field(np.zeros((size, 3)), np.zeros((3, 3)), np.array([1.0, 0.0, 0.0]) * 50 + 0)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    rows, tags = [rows[i] for i in order], [tags[i] for i in order]
    n, longest = len(rows), len(rows[0])
    live = [sum(len(r) > t for r in rows) for t in range(longest)]
    flat = np.concatenate(rows)
    used, flat = np.unique(flat, return_inverse=True)
    flat = flat.reshape(-1, rows[0].shape[1])
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    at = [begin[:m] + t for t, m in enumerate(live)]
    truth = np.concatenate(tags)
    onehot = np.eye(3)[truth]
    pairs = np.zeros((3, 3))
    for t in tags:
        np.add.at(pairs, (t[:-1], t[1:]), 1)
    k = len(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        emission, transition, first = x[: 3 * k].reshape(k, 3), x[3 * k : 3 * k + 9].reshape(3, 3), x[3 * k + 9 :]
        score = emission[flat].sum(axis=1)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[at[0]] = first + score[at[0]]
        for t in range(1, longest):
            alpha[at[t]] = _logsumexp(alpha[at[t - 1][: live[t]], :, None] + transition, 1) + score[at[t]]
        z = _logsumexp(alpha[begin + [len(r) - 1 for r in rows]], 1)
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            beta[at[t][:m]] = _logsumexp(transition + (score[at[t + 1]] + beta[at[t + 1]])[:, None, :], 2)
        which = np.repeat(np.arange(n), [len(r) for r in rows])
        marginal = np.exp(alpha + beta - z[which][:, None])
        expected = np.zeros((3, 3))
        for t in range(1, longest):
            m = live[t]
            joint = alpha[at[t - 1][:m], :, None] + transition + (score[at[t]] + beta[at[t]])[:, None, :]
            expected += np.exp(joint - z[:m, None, None]).sum(axis=0)
        gold = (score * onehot).sum() + (pairs * transition).sum() + first[truth[begin]].sum()
        d = marginal - onehot
        g_e = np.stack([np.bincount(flat.ravel(), weights=np.repeat(d[:, j], flat.shape[1]), minlength=k) for j in range(3)], axis=1)
        g_f = marginal[begin].sum(axis=0) - onehot[begin].sum(axis=0)
        grad = np.concatenate([g_e.ravel(), (expected - pairs).ravel(), g_f]) / n + l2 * x
        return float((z.sum() - gold) / n + l2 / 2 * (x @ x)), grad

    x = minimise(loss, np.zeros(3 * k + 12), rounds)
    full = np.zeros((size, 3))
    full[used] = x[: 3 * k].reshape(k, 3)
    return Field(full, x[3 * k : 3 * k + 9].reshape(3, 3), x[3 * k + 9 :])


def sequences(text: str, found: list[tuple[int, int, str]], labels: list[tuple[str, re.Match]] = ()):
    """(token spans, slots, tags) of each window; a base match in ``labels`` tags the secret itself."""
    yield from tagged(text, windows(text, found), labels)


def plain_sequences(text: str, labels: list[tuple[str, re.Match]]):
    """As :func:`sequences`, of all tokens of all lines in pieces of at most ``PLAIN_TOKENS``."""
    pieces, start = [], 0
    for line in text.split("\n"):
        spans = [m.span() for m in _TOKEN.finditer(text, start, start + len(line))]
        pieces += [spans[i : i + PLAIN_TOKENS] for i in range(0, len(spans), PLAIN_TOKENS)]
        start += len(line) + 1
    yield from tagged(text, pieces, labels)


def tagged(text: str, spans_of: list[list[tuple[int, int]]], labels: list[tuple[str, re.Match]]):
    whole = file_features(text) if spans_of else []
    secret = sorted(m.span(2) if k == "assign" else m.span() for k, m in labels)
    for spans in spans_of:
        rows = slots([text[a:b] for a, b in spans], whole)
        tags = np.zeros(len(spans), dtype=np.int64)
        for a, b in secret:
            inside = [i for i, (c, d) in enumerate(spans) if c < b and d > a]
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
        yield spans, rows, tags


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Field:
    """Fit on the windows of at most ``sample`` documents and on all lines of one in ``PLAIN_ONE_IN`` of them."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")

    def run(c: dict):
        made = []
        for text in texts_of(c["text"]):
            found = hits(text)
            base = matches(text, found)
            plain = zlib.crc32(text.encode()) % PLAIN_ONE_IN == 0
            cut = plain_sequences(text, base) if plain else sequences(text, found, base)
            made += [(r.astype(np.int32).tobytes(), t.astype(np.int8).tobytes()) for _, r, t in cut]
        return {"slots": [m[0] for m in made], "tags": [m[1] for m in made]}

    got = map_rows(rows, run, "slots binary, tags binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["slots"], r["tags"]))
    tags = [np.frombuffer(r["tags"], np.int8).astype(np.int64) for r in got]
    return fit_sequences([np.frombuffer(r["slots"], np.int32).astype(np.int64).reshape(len(t), -1) for r, t in zip(got, tags, strict=True)], tags)


def tagged_spans(text: str, tags: list[int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets of a text's tags that are long enough and overlap none of the ``base`` spans."""
    tokens, out, i = [m.span() for m in _TOKEN.finditer(text)], [], 0
    while i < len(tags):
        j = i + 1
        if tags[i] != OUT:
            while j < len(tags) and tags[j] == INSIDE and tokens[j][0] == tokens[j - 1][1]:
                j += 1
            a, b = tokens[i][0], tokens[j - 1][1]
            if b - a >= LEAST and not any(c < b and d > a for _, c, d in base):
                out.append(("tagged", a, b))
        i = j
    return out


def find_all(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """For each text the base spans and the tagged ones that overlap none of them, by start and then kind."""
    out = [[(k, *m.span()) for k, m in matches(t, hits(t))] for t in texts]
    low, size = 0, 0
    for high in range(1, len(texts) + 1):
        size += len(texts[high - 1])
        if size < CHUNK_CHARS and high < len(texts):
            continue
        owner, tags = tagger.tags(texts[low:high])
        first = np.searchsorted(owner, np.arange(high - low + 1))
        for i in np.unique(owner[tags != OUT]).tolist():
            out[low + i] += tagged_spans(texts[low + i], tags[first[i] : first[i + 1]].tolist(), out[low + i])
        low, size = high, 0
    return [sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for spans in out]


def find(text: str, field: Field) -> list[tuple[str, int, int]]:
    """:func:`find_all` of one text."""
    return find_all([text], Tagger(field))[0]


def report(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, digest of the base spans, all spans.

    NULL text counts as empty; other columns of ``docs`` are not read.
    """
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(c: dict):
        out = {"doc_id": c["doc_id"]} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
        kept = worker_cache("crf_secrets")
        if kept.get("name") != name:
            kept.update(name=name, tagger=Tagger(shared.value))
        for found in find_all(texts_of(c["text"]), kept["tagger"]):
            spans = [(k, f"{k}:{a}:{b}") for k, a, b in found]
            base = ",".join(s for k, s in spans if k in BASE)
            for kind in BASE:
                out[f"n_{kind}"].append(sum(k == kind for k, _ in spans))
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(s for _, s in spans))
        return out

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}, base_sha256 string, spans string")


def scan(docs: DataFrame) -> DataFrame:
    """Fit on the corpus and report on all of it."""
    return report(docs, fit(docs))
