"""Personal data: fixed patterns, and a skip-chain conditional random field over words.

Each word is private or not. Neighbouring words share a potential, and so do occurrences of
the same or a similar word anywhere in a document (of four letters or digits at least, equal but
for case, signs around and in it, and a name such as ``token=`` before it; each occurrence is
tied to the one before, so edges grow with the words). Such a graph has loops; loopy message passing gives the marginals, in training and in use. The field is
trained on weak labels: what the patterns find, and values assigned to names like ``token``.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import SAME_TABLE, SPACES, Words, _Tables, filled, span_hashes, steps

# ---- fixed values: kinds and their patterns ----
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
# ---- end of fixed values ----

# Kinds of the spans that the field adds: long mixed codes, and anything else.
ADDED = ("secret", "private")
THRESHOLD = 0.5
# Distinct texts the field is trained on, at most about; half of them with a weak label where there are as many.
TRAINING_ROWS = 800
ROUNDS, PASSES, RATE, DECAY = 8, 80, 0.25, 1e-5
# Log-odds that move by less count as settled.
TOLERANCE = 1e-3

_SECRET = re.compile(r"""(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|key|auth)["']?\s*[=:]\s*["']?([A-Za-z0-9_+/-]{12,})""")
_NAMES = {b"token", b"secret", b"password", b"passwd", b"pwd", b"apikey", b"key", b"auth"}


# ---- patterns ----------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# The fixed patterns cut so that a search is linear: an e-mail address by its @, the part before it
# read backwards, and an address of numbers only from the start of a run of digits.
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(EMAIL.pattern.partition("@")[2])
_IP_RUN = re.compile("(?<![0-9])" + IP.pattern.replace("]+", "]++"))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Where ``EMAIL`` matches, from left to right without overlaps."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Where ``IP`` matches with all parts in range."""
    for m in _IP_RUN.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every valid match, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = KINDS + ADDED
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


# ---- the field ---------------------------------------------------------------------------


class Graph:
    """Words of a run of texts, features of those that have any, and the skip edges."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, SAME_TABLE, SPACES)
        n, data = len(w), w.data
        self.head = np.zeros(n, bool)
        self.head[w.first[:-1][w.counts > 0]] = True
        self.tail = np.zeros(n, bool)
        self.tail[w.first[1:][w.counts > 0] - 1] = True
        doc = w.doc
        # words with a mark, private names, and two to each side of them in their text
        flag = np.zeros(256, bool)
        flag[list(b'0123456789@"=:')] = True
        marks = np.concatenate(([0], np.cumsum(flag[data], dtype=np.int32)))
        letters, _ = _hashes(data, w.start, w.end, LETTERS)
        odd = np.flatnonzero((marks[w.end] > marks[w.start]) | np.isin(letters, _name_hashes()))
        close = np.unique(np.concatenate([
            np.clip(odd + k, w.first[doc[odd]], w.first[doc[odd] + 1] - 1) for k in (-2, -1, 0, 1, 2)]))
        # any other word has no feature but its length
        self.near = near = np.union1d(close, np.flatnonzero(w.end - w.start >= LONG))
        body = data.tobytes()
        text = [body[a:b] for a, b in zip(w.start[near].tolist(), w.end[near].tolist())]
        own = np.array([_seen_features(t) for t in text], np.float32).reshape(len(near), _OWN)
        own[:, _CLOSE] = np.isin(near, close)

        def pick(k: int, column: int) -> np.ndarray:
            """A feature of the word ``k`` places on in the same text, else 0."""
            other = near + k
            at = np.searchsorted(near, other)
            at[at == len(near)] = 0
            there = (near[at] == other) & (doc[near[at]] == doc[near])
            return np.where(there, own[at, column], 0)

        if len(near):
            assigned, named = pick(-1, _ASSIGNS), pick(-1, _NAMED)
            context = np.stack([
                pick(-1, _DIGITS), pick(1, _DIGITS), assigned * own[:, _LENGTH], assigned * np.maximum(named, pick(-2, _NAMED)),
                named * own[:, _LENGTH]], 1).astype(np.float32)
            self.x = np.concatenate((own, context), 1)
        else:
            self.x = np.zeros((0, FEATURES), np.float32)
        # occurrences of like words, each tied to the one before
        start = w.start.copy()
        inside = np.concatenate(([0], np.cumsum((data == 61) | (data == 58), dtype=np.int32)))
        for i in np.flatnonzero(inside[np.maximum(w.end - 1, w.start)] > inside[w.start]).tolist():
            start[i] += _value_at(body[w.start[i]:w.end[i]])
        key, size = _hashes(data, start, w.end, LIKE)
        rows = np.flatnonzero(size >= 4)
        rows = rows[np.lexsort((key[rows], doc[rows]))]
        like = (key[rows[1:]] == key[rows[:-1]]) & (doc[rows[1:]] == doc[rows[:-1]])
        edges = np.stack((rows[:-1][like], rows[1:][like]), 1)
        self.edges = edges[np.argsort(edges[:, 1])]
        ends = np.flatnonzero(np.concatenate(([True], ~like, [True])))
        self.longest = int(np.diff(ends).max())  # most occurrences of like words, 1 at least

    def marginals(self, weight: np.ndarray, chain: float, skip: float) -> tuple[np.ndarray, ...]:
        """Log-odds of private for each word once the messages have settled, and the messages.

        A potential adds ``chain`` or ``skip`` where both its words are private, so the message
        along an edge is log((1 + exp(c + potential)) / (1 + exp(c))), c being the log-odds of the
        sender without what the receiver told it. After ``ROUNDS`` rounds over all words only those
        whose log-odds still move by more than ``TOLERANCE`` send again, until none does.
        """
        n = len(self.words)
        u = np.full(n, weight[0], np.float32)
        u[self.near] += self.x @ weight[1:].astype(np.float32)
        a, b = self.edges.T  # a word is at most once in a and once in b
        left, right, to_b, to_a = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(len(a), np.float32), np.zeros(len(a), np.float32)
        inner, outer, tie = ~self.head[1:], np.float32(np.exp(chain)), np.float32(np.exp(skip))

        def summed() -> np.ndarray:
            out = u + left + right
            out[b] += to_b
            out[a] += to_a
            return out

        total, before = u, u
        for _ in range(ROUNDS):
            before = total
            gone = total - right
            come = total - left
            left[1:] = _message(gone[:-1], outer) * inner
            right[:-1] = _message(come[1:], outer) * inner
            to_b, to_a = _message(total[a] - to_a, tie), _message(total[b] - to_b, tie)
            total = summed()
        moved = np.flatnonzero(np.abs(total - before) > TOLERANCE)
        if not len(moved):
            return total, left, right, to_b, to_a
        as_a, as_b = np.full(n, -1), np.full(n, -1)
        as_a[a], as_b[b] = np.arange(len(a)), np.arange(len(b))
        # Potentials of no less than 0 only raise messages, which are bounded, so they settle. Others
        # may swing: they go half the way, and for a number of rounds that the longest path bounds.
        pulls = min(chain, skip) < 0
        share, rounds = np.float32(0.5 if pulls else 1), 0
        while len(moved) and not (pulls and rounds > 4 * (self.longest + 50)):
            rounds += 1
            last, first = moved[~self.tail[moved]], moved[~self.head[moved]]
            e, f = as_a[moved], as_b[moved]
            e, f = e[e >= 0], f[f >= 0]
            sent = [(left, last + 1, last, last + 1, _message(total[last] - right[last], outer)),
                    (right, first - 1, first, first - 1, _message(total[first] - left[first], outer)),
                    (to_b, e, a[e], b[e], _message(total[a[e]] - to_a[e], tie)),
                    (to_a, f, b[f], a[f], _message(total[b[f]] - to_b[f], tie))]
            next_moved = [moved[:0]]
            for messages, at, sender, word, new in sent:
                step = share * (new - messages[at])
                messages[at] += step
                total[word] += step
                far = np.abs(step) > TOLERANCE
                next_moved.append(word[far])
                if pulls:  # the rest of the way is still to go
                    next_moved.append(sender[far])
            moved = np.unique(np.concatenate(next_moved))
        return summed(), left, right, to_b, to_a


def _message(c: np.ndarray, factor: np.float32) -> np.ndarray:
    e = np.exp(np.clip(c, -30, 30))
    return np.log((1 + e * factor) / (1 + e))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of what ``table`` leaves of each word; it makes 0 of the bytes to drop."""
    body = table[data]
    kept = np.concatenate(([0], np.cumsum(body > 0, dtype=np.int64)))
    return span_hashes(body[body > 0], kept[start], kept[end]), kept[end] - kept[start]


def _name_hashes() -> np.ndarray:
    names = sorted(_NAMES)
    ends = np.cumsum([len(x) for x in names])
    return span_hashes(np.frombuffer(b"".join(names), np.uint8), np.append(0, ends[:-1]), ends)


def _value_at(word: bytes) -> int:
    """Where the value starts in a word such as token="abc"; 0 in words without a private name."""
    name, sign, value = re.fullmatch(rb"([^=:]*)([=:]*)(.*)", word, re.S).groups()
    named = re.sub(rb"[^a-z]", b"", name.lower()) in _NAMES and re.search(rb"[0-9A-Za-z\x80-\xff]", value)
    return len(name + sign) if named else 0


# Letters a-z, and what like words have in common, from any byte; 0 where a byte is dropped.
LETTERS = np.array([b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
LIKE = np.array([b if b >= 128 or 48 <= b <= 57 else LETTERS[b] for b in range(256)], np.uint8)
LONG = 12
_DIGITS, _LENGTH, _ASSIGNS, _NAMED, _CLOSE = range(5)
_OWN = 21
FEATURES = _OWN + 5


_SEEN = _Tables()  # features of the words met last


def _seen_features(word: bytes) -> list[float]:
    if word not in _SEEN:
        if len(_SEEN) >= 1 << 16:
            _SEEN.clear()
        _SEEN[word] = _features(word)
    return _SEEN[word]


def _features(word: bytes) -> list[float]:
    """What a word looks like; the first four are also read from its neighbours."""
    core = word.strip(b"\"'.,;:!?#$%&*|<>()[]{}")
    digits = sum(48 <= c <= 57 for c in core)
    n = max(1, len(core))
    letters = len(re.findall(rb"[A-Za-z\x80-\xff]", core))
    whole = core.isdigit()
    address = bool(re.fullmatch(rb"[0-9]+(\.[0-9]+){3}", core))
    valid = address and all(len(p) <= 3 and int(p) <= 255 for p in core.split(b"."))
    card = whole and 14 <= digits <= 19
    return [
        digits > 0, n >= LONG, word[-1:] in b"=:" or core == b"=", re.sub(rb"[^a-z]", b"", core.lower()) in _NAMES,
        1.0, digits / n, whole, n >= 12 and digits > 0 and letters > 0, b"@" in core and b"." in core.partition(b"@")[2],
        b"@" in core, address, valid, card, card and luhn(core.decode()), word[:1] == b"+" and digits > 0,
        word[:1] == b"(" and digits == 3, digits >= 6 and b"-" in core, word[:1] in b"\"'" and n >= 12, digits in (1, 2, 3), n >= 20,
        len(word) - _value_at(word) >= LONG and _value_at(word) > 0,
    ]


class SkipChainField:
    def __init__(self):
        self.weight, self.chain, self.skip = np.concatenate(([-8.0], np.zeros(FEATURES))), 0.0, 0.0

    def private(self, graph: Graph) -> np.ndarray:
        return np.flatnonzero(graph.marginals(self.weight, self.chain, self.skip)[0] >= np.log(THRESHOLD / (1 - THRESHOLD)))

    @classmethod
    def fit(cls, texts: pa.Array) -> SkipChainField:
        """Ascend the likelihood of the weak labels, its expectations taken from message passing."""
        model = cls()
        if not len(texts):
            return model
        texts = _with_repeats(texts)
        g = Graph(texts)
        y = _weak_labels(texts, g)
        if not y.any():
            return model
        inner = np.flatnonzero(~g.head)
        a, b = g.edges.T
        both = (float((y[inner - 1] * y[inner]).sum()), float((y[a] * y[b]).sum()))
        params = np.concatenate((model.weight, [0.0, 0.0]))
        params[0] = -6.0
        size, m, v = float(y.sum()), 0.0, 0.0
        for k in range(1, PASSES + 1):
            chain, skip = params[-2:]
            total, left, right, to_b, to_a = g.marginals(params[:-2], chain, skip)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            expected = (_both(total[inner - 1] - right[inner - 1], total[inner] - left[inner], chain),
                        _both(total[a] - to_a, total[b] - to_b, skip))
            rest = y - p
            grad = np.concatenate(([rest.sum()], rest[g.near] @ g.x, [x - e for x, e in zip(both, expected)])) / size - DECAY * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            params[-2:] = np.clip(params[-2:], -4, 4)  # stronger ties would keep the messages from settling
        model.weight, (model.chain, model.skip) = params[:-2], params[-2:].tolist()
        return model


def _both(c: np.ndarray, d: np.ndarray, potential: float) -> float:
    """Expected number of edges with both ends private."""
    c, d = np.clip(c, -30, 30).astype(float), np.clip(d, -30, 30).astype(float)
    joint = np.exp(c + d + potential)
    return float((joint / (1 + np.exp(c) + np.exp(d) + joint)).sum())


def _with_repeats(texts: pa.Array) -> pa.Array:
    """The texts, half of them with one of their private values up to three times more, bare, after words picked by
    hash: texts seldom repeat them, and the tie between like words is to be learned too."""
    out = []
    for text in filled(texts).to_pylist():
        values = [m.group(1) for m in _SECRET.finditer(text)] + [v for a, _, b in base_spans(text) if " " not in (v := text[a:b])]
        gaps = [m.start() for m in re.finditer(" ", text)]
        pick = zlib.crc32(text.encode())
        if values and gaps and pick % 2:
            value = values[pick // 2 % len(values)]
            for k in range(1 + pick // 4 % 3):
                at = gaps[(pick // 2 + k * 7919) % len(gaps)]
                text = f"{text[:at]} {value}{text[at:]}"
        out.append(text)
    return pa.array(out, pa.large_string())


def _weak_labels(texts: pa.Array, graph: Graph) -> np.ndarray:
    """1 for the words of pattern spans and assigned values, and for like words of a text that one of
    these makes up alone: what is private once is private wherever the text repeats it."""
    words = graph.words
    y, alone = np.zeros((2, len(words)), np.float32)
    for d, text in enumerate(filled(texts).to_pylist()):
        spans = [(a, b) for a, _, b in base_spans(text)] + [m.span(1) for m in _SECRET.finditer(text)]
        for a, b in spans:
            a, b = (len(text[:x].encode()) + int(words.ends[d]) for x in (a, b))
            at = slice(int(np.searchsorted(words.end, a, side="right")), int(np.searchsorted(words.start, b)))
            y[at] = 1
            alone[at] = at.stop - at.start == 1
    first, second = graph.edges.T
    while True:
        ends = np.maximum(alone[first], alone[second])
        if (ends == alone[first]).all() and (ends == alone[second]).all():
            return np.maximum(y, alone)
        alone[first] = ends
        alone[second] = np.maximum(alone[second], ends)


# ---- spans -------------------------------------------------------------------------------


def all_spans(texts: pa.Array, model: SkipChainField) -> list[tuple[list, list]]:
    """Per text: the pattern spans, and these with the field's spans that don't touch them."""
    graph = Graph(texts)
    w = graph.words
    hits = model.private(graph)
    doc = np.searchsorted(w.first, hits, side="right") - 1
    found: dict[int, list[int]] = {}
    for d, i in zip(doc.tolist(), hits.tolist()):
        found.setdefault(d, []).append(i)
    out = []
    for d, text in enumerate(filled(texts).to_pylist()):
        base = base_spans(text)
        added: list[tuple[int, int, int, int]] = []  # start, kind, end, word
        body = text.encode() if d in found else b""
        for i in found.get(d, ()):
            a, b = int(w.start[i] - w.ends[d]), int(w.end[i] - w.ends[d])
            piece = body[a:b].decode()
            inner = re.search(r"\w(?:.*\w)?", piece, re.S)
            if inner is None:
                continue
            start = len(body[:a].decode()) + inner.start()
            core = inner.group()
            end = start + len(core)
            if any(start < z and x < end for x, _, z in base):
                continue
            code = len(core) >= 12 and "@" not in core and re.search("[0-9]", core) and re.search("[A-Za-z]", core)
            if not code and added and added[-1][3] == i - 1 and added[-1][1] == len(KINDS) + 1:
                added[-1] = (added[-1][0], len(KINDS) + 1, end, i)  # words in a row make one span
            else:
                added.append((start, len(KINDS) + (0 if code else 1), end, i))
        out.append((base, sorted(base + [s[:3] for s in added])))
    return out


# ---- Spark -------------------------------------------------------------------------------


def fit(docs: DataFrame, *, text_col: str = "text", training_rows: int = TRAINING_ROWS) -> SkipChainField:
    """Train on a bounded number of distinct texts; all documents are searched with the result.

    Half of them, or all there are where that is less, have a weak label; the others are texts
    without one that hold a digit, an @ or an assignment to a private name. Both are picked by hash.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") | F.col("text").rlike(_SECRET.pattern))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [bool(_SECRET.search(t) or base_spans(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"text": batch.column("text"), "h": batch.column("h"), "labelled": pa.array(yes, pa.bool_())})

    rows = rows.withColumn("h", F.xxhash64("text").bitwiseAND((1 << 63) - 1)).mapInArrow(labelled, "text string, h long, labelled boolean")
    distinct = rows.select("h", "labelled").distinct().groupBy("labelled").count()
    n = {r["labelled"]: r["count"] for r in distinct.collect()}
    wanted = {True: training_rows // 2}
    wanted[False] = training_rows - min(wanted[True], n.get(True, 0))
    below = {k: int(min(1.0, v / max(1, n.get(k, 0))) * (1 << 62)) * 2 - 1 for k, v in wanted.items()}
    picked = rows.where(F.col("h") <= F.when(F.col("labelled"), F.lit(below[True])).otherwise(F.lit(below[False]))).select("text").distinct().toArrow()
    texts = sorted(picked.column("text").to_pylist())
    return SkipChainField.fit(pa.array(texts, pa.large_string()))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, model: SkipChainField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern counts, a digest of the pattern spans and all spans of every row.

    Spans are kind:start:end in code points, end exclusive, by start and kind. Null text counts
    as empty; texts without spans have the digest of the empty text and an empty list.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            spans = all_spans(batch.column("text"), model)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                **{f"n_{kind}": pa.array([sum(s[1] == k for s in base) for base, _ in spans], pa.int64()) for k, kind in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in spans],
                "spans": [joined(every) for _, every in spans],
            })

    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
