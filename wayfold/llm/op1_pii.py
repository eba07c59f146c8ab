"""Personal data: a linear-chain conditional random field over word shapes, besides exact base patterns.

Words (runs without white space) become shape codes in numpy: character classes, digit and dot counts, first and last
class, length, hexadecimal. The field (labels ``LABELS``) is trained on the driver from a small labelled table made by
rule (``labelled_table``), by Adam on the exact log-likelihood with forward-backward in numpy batches. Decoding is
Viterbi over batches of segments. Segments come from an exact bound: where the label O beats every other label by more
than any two transitions can make up, the word is O on every best path, and the chain is cut there; all that remains,
a few words in a hundred, is decoded.

The base patterns run over maximal runs of the characters a match can hold, so every text is covered whole in linear
time. Spans of the field that overlap no base span are added.

Cases: null and empty texts have no spans; a text of any length is handled in one piece of memory proportional to it;
repeated rows give equal values; an empty table gives no rows; other columns are not read, or pass through ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, blocks, code_points, owner, runs

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+", "secret")
_KIND_OF = np.array([-1, 0, 1, 2, 2, 3, 3, 4])
_GOES_ON = np.array([0, 0, 0, 0, 1, 0, 1, 0], bool)

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = bytes(set(range(256)) - set(range(48, 58)))


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_NUMERIC = _set(b"0123456789 .()+-")
_DIGITS = _set(b"0123456789")
_LOCAL = _set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: bytes) -> bool:
    d = [x - 48 for x in digits[::-1]]
    return (sum(d[::2]) + sum((2 * x - 9 if x > 4 else 2 * x) for x in d[1::2])) % 10 == 0


def _emails(text: bytes):
    """Leftmost non-overlapping: the local part is the whole run before an @, as far as the last match."""
    end = 0
    at = text.find(b"@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > end and _LOCAL[text[start - 1]]:
                start -= 1
            if start < at:
                yield start, m.end()
                end = m.end()
        at = text.find(b"@", max(at + 1, end))


def _numeric(part: bytes):
    for m in _IP.finditer(part):
        if all(len(x.lstrip(b"0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split(b".")):
            yield 1, m.start(), m.end()
    for m in _CARD.finditer(part):
        d = m[0].translate(None, _NOT_DIGIT)
        if 13 <= len(d) <= 19 and luhn(d):
            yield 2, m.start(), m.end()
    for m in _PHONE.finditer(part):
        if 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
            yield 3, m.start(), m.end()


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) in bytes of the block."""
    found = []
    starts, ends = runs(_NUMERIC[data], offsets)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGITS[data], out=digits[1:])
    some = np.flatnonzero(digits[ends] - digits[starts] >= 4)
    for a, b, t in zip(starts[some].tolist(), ends[some].tolist(), owner(starts[some], offsets).tolist()):
        found += [(t, k, a + s, a + e) for k, s, e in _numeric(data[a:b].tobytes())]
    for t in np.unique(owner(np.flatnonzero(data == 64), offsets)).tolist():
        a = int(offsets[t])
        found += [(t, 0, a + s, a + e) for s, e in _emails(data[a : offsets[t + 1]].tobytes())]
    return found


# --- word shapes -----------------------------------------------------------------------------------------------------

#: Classes of a byte: small letter or beyond ASCII, capital, digit, @, point or comma, plus, hyphen or brackets, other.
_CLASS = np.full(256, 7, np.int64)
for _chars, _k in ((range(97, 123), 0), (range(128, 256), 0), (range(65, 91), 1), (range(48, 58), 2), (b"@", 3), (b".,", 4), (b"+", 5), (b"-()", 6)):
    _CLASS[list(_chars)] = _k
_BIT = (1 << _CLASS).astype(np.uint8)
_HEX = _set(b"0123456789abcdefABCDEF\"'")
_DOT = _set(b".")
_DIGIT_STEP = np.searchsorted([1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 13, 16, 17, 20], np.arange(64), side="right")
_LENGTH_STEP = np.searchsorted([2, 4, 8, 14, 16, 20, 32], np.arange(64), side="right")
#: Sizes of the features: classes present, digits, dots, first and last class, length, digits with classes of the ends.
SIZES = (256, 16, 5, 64, 16, 16 * 64)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One packed code a word."""
    if not len(starts):
        return np.zeros(0, np.int64)
    border = np.empty(2 * len(starts), np.int64)
    border[::2], border[1::2] = starts, np.minimum(ends, len(data) - 1)
    closed = ends[-1] == len(data)
    take = border[:-1] if closed else border
    present = np.bitwise_or.reduceat(_BIT[data], take)[::2].astype(np.int64)
    counts = []
    total = np.zeros(len(data) + 1, np.int64)
    for chars in (_DIGITS, _DOT, _HEX):
        np.cumsum(chars[data], out=total[1:])
        counts.append(total[ends] - total[starts])
    length = ends - starts
    digit = _DIGIT_STEP[np.minimum(counts[0], 63)]
    dots = np.minimum(counts[1], 4)
    size = _LENGTH_STEP[np.minimum(length, 63)] * 2 + (counts[2] == length)
    return (((((present << 4 | digit) << 3 | dots) << 3 | _CLASS[data[starts]]) << 3 | _CLASS[data[ends - 1]]) << 4) | size


def unpack(codes: np.ndarray) -> list[np.ndarray]:
    size, ends, dots, digit, present = codes & 15, codes >> 4 & 63, codes >> 10 & 7, codes >> 13 & 15, codes >> 17
    return [present, digit, dots, ends, size, digit * 64 + ends]


# --- training --------------------------------------------------------------------------------------------------------


def labelled_table(rows: int = 700, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(sentence, label of each word), by rule: plain words, hard negatives (years, prices, versions, dates, counts), and
    each kind in several spellings, with and without marks after it."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    hexes = lambda n: "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, n))

    def plain():
        w = letters(rng.integers(1, 13 if rng.random() < 0.7 else 40))
        w = [w, w, w, w.capitalize(), w.upper()][rng.integers(0, 5)]
        w = ["é" + w, w][int(rng.random() < 0.9)]
        return w + ["", "", "", "", ",", ".", "!!", "%%%", "###", "$$$", "&&&", "-" + w, ":", ")"][rng.integers(0, 14)]

    def negative():
        return [digits(rng.integers(1, 5)), digits(1) + ".0.", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)},{digits(3)}", f"19{digits(2)}-0{digits(1)}-1{digits(1)}", f"(v{digits(1)}.{digits(1)})", digits(rng.integers(5, 9)), f"{letters(4)}{digits(2)}", f"{digits(2)}:{digits(2)}", "$" + digits(3), f"@{letters(6)}", f"{digits(1)}-{digits(1)}", "+" + digits(1), "|", "="][rng.integers(0, 15)]

    def entity():
        kind = rng.integers(0, 5)
        if kind == 0:
            return [(f"{letters(4)}.{digits(2)}@{letters(4)}{digits(1)}.{letters(7)}.com" if rng.random() < 0.6 else f"{letters(6)}@{letters(5)}.org", 1)]
        if kind == 1:
            return [(".".join(str(x) for x in rng.integers(0, 256, 4)), 2)]
        if kind == 2:
            form = rng.integers(0, 3)
            if form == 0:
                return [(digits(16), 3)]
            if form == 1:
                return [(digits(4), 3), (digits(4), 4), (digits(4), 4), (digits(4), 4)]
            return [("-".join(digits(4) for _ in range(4)), 3)]
        if kind == 3:
            form = rng.integers(0, 5)
            tail = f"{digits(3)}-{digits(4)}"
            return [[("+" + digits(1), 5), (f"({digits(3)})", 6), (tail, 6)], [(f"({digits(3)})", 5), (tail, 6)], [(f"+{digits(11)}", 5)], [(f"{digits(3)}-{tail}", 5)], [(f"+{digits(2)}", 5), (digits(2), 6), (digits(4), 6), (digits(4), 6)]][form]
        return [([f'"{hexes(40)}"', hexes(40), hexes(32), "AKIA" + letters(8).upper() + digits(4) + letters(4).upper()][rng.integers(0, 4)], 7)]

    table = []
    for _ in range(rows):
        words: list[tuple[str, int]] = []
        for _ in range(rng.integers(3, 8)):
            words += [(plain(), 0) for _ in range(rng.integers(0, 4))]
            what = rng.random()
            if what < 0.3:
                words.append((negative(), 0))
            elif what < 0.65:
                got = entity()
                mark = ["", "", "", ".", ",", "!!", "%%%", "###"][rng.integers(0, 8)]
                got[-1] = (got[-1][0] + mark, got[-1][1])
                words += [*got, (plain(), 0)]
        if words:
            table.append((" ".join(w for w, _ in words), [k for _, k in words]))
    return table


class Field:
    """Weights: one table (values x labels) for each feature, transitions (from x to)."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray):
        self.tables, self.moves = tables, moves

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return sum(t[f] for t, f in zip(self.tables, unpack(codes)))

    def surely_outside(self, emissions: np.ndarray) -> np.ndarray:
        """Words whose best label is O whatever stands around them."""
        m = self.moves
        gain = (m[:, None, :] + m.T[None, :, :]) - (m[:, 0][:, None, None] + m[0][None, :, None])  # [before, after, label]
        return (emissions[:, :1] - emissions[:, 1:] > gain.max(axis=(0, 1))[1:] + 1e-9).all(axis=1)

    def decode(self, emissions: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Viterbi labels of segments (begin, length) that have O on both sides, all segments of a step in one batch."""
        out = np.zeros(len(emissions), np.int64)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        score, back = None, []
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, side="left"))  # segments longer than t
            here = emissions[begin[:n] + t]
            if t == 0:
                score = self.moves[0] + here
                back.append(None)
            else:
                paths = score[:n, :, None] + self.moves[None]
                back.append(paths.argmax(axis=1).astype(np.int8))
                score[:n] = paths.max(axis=1) + here
        if score is None:
            return out
        label = (score + self.moves[:, 0]).argmax(axis=1)
        for t in range(len(back) - 1, -1, -1):
            n = int(np.searchsorted(-length, -t, side="left"))
            out[begin[:n] + t] = label[:n]
            if t:
                label[:n] = back[t][np.arange(n), label[:n]]
        return out


@functools.lru_cache(maxsize=1)
def trained(rounds: int = 160) -> Field:
    """The field of the labelled table: exact gradients by forward-backward over the padded table."""
    table = labelled_table()
    data = np.frombuffer("\n".join(t for t, _ in table).encode(), np.uint8)
    starts, ends = runs(~SPACE[data], np.array([0, len(data)]))
    codes = shapes(data, starts, ends)
    gold = np.array([k for _, ks in table for k in ks])
    lengths = np.array([len(ks) for _, ks in table])
    first = np.cumsum(lengths) - lengths
    width, k = int(lengths.max()), len(LABELS)
    grid = np.arange(width)[None] < lengths[:, None]
    where = np.minimum(first[:, None] + np.arange(width)[None], len(codes) - 1)
    parts = unpack(codes)
    tables, moves = [np.zeros((n, k)) for n in SIZES], np.zeros((k, k))
    weights = [*tables, moves]
    ones, twos = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    hot = np.eye(k)
    gold_moves = np.zeros((k, k))
    for a, n in zip(first, lengths):
        path = [0, *gold[a : a + n], 0]
        np.add.at(gold_moves, (path[:-1], path[1:]), 1)
    for step in range(1, rounds + 1):
        e = sum(t[f] for t, f in zip(tables, parts))[where]
        exp = np.exp(moves)
        alpha, scale = np.zeros((len(table), width, k)), np.zeros((len(table), width))
        top = e.max(axis=2, keepdims=True)
        ee = np.exp(e - top)
        for t in range(width):
            a = (exp[0][None] if t == 0 else alpha[:, t - 1] @ exp) * ee[:, t]
            scale[:, t] = a.sum(axis=1)
            alpha[:, t] = np.where(grid[:, t : t + 1], a / scale[:, t : t + 1], alpha[:, t - 1] if t else a)
        beta = np.zeros((len(table), k)) + exp[:, 0]
        post = np.zeros((len(table), width, k))
        move_post = np.zeros((k, k))
        for t in range(width - 1, -1, -1):
            on = grid[:, t]
            p = alpha[:, t] * beta
            p /= p.sum(axis=1, keepdims=True)
            post[on, t] = p[on]
            last = on & (t == lengths - 1)
            move_post[:, 0] += p[last].sum(axis=0)
            before = alpha[:, t - 1] if t else hot[np.zeros(len(table), int)]
            joint = before[:, :, None] * exp[None] * (ee[:, t] * beta)[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            move_post += joint[on].sum(axis=0)
            new = (ee[:, t] * beta) @ exp.T
            beta = np.where(on[:, None], new / new.sum(axis=1, keepdims=True), beta)
        diff = hot[gold] - post[grid]
        grads = [np.zeros_like(t) for t in tables]
        for g, f in zip(grads, parts):
            np.add.at(g, f, diff)
        grads.append(gold_moves - move_post)
        for w, g, m, v in zip(weights, grads, ones, twos):
            g -= 0.05 * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field(tables, moves)


# --- spans -----------------------------------------------------------------------------------------------------------

_TRIM = b".,;:!?\"'<>[]{}%&$#*=|_"


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) that Viterbi finds, marks around them left off."""
    starts, ends = runs(~SPACE[data], offsets)
    if not len(starts):
        return []
    codes = shapes(data, starts, ends)
    whose = owner(starts, offsets)
    kinds, back = np.unique(codes, return_inverse=True)
    known = field.emissions(kinds)
    open_ = ~field.surely_outside(known)[back]
    inside = np.flatnonzero(open_)
    if not len(inside):
        return []
    new = np.ones(len(inside), bool)
    new[1:] = (inside[1:] != inside[:-1] + 1) | (whose[inside[1:]] != whose[inside[:-1]])
    begin = np.flatnonzero(new)
    labels = field.decode(known[back[inside]], begin, np.diff(np.append(begin, len(inside))))
    found: list[tuple[int, int, int, int]] = []
    for i in np.flatnonzero(labels):
        w, kind = inside[i], int(_KIND_OF[labels[i]])
        if _GOES_ON[labels[i]] and found and not new[i] and labels[i - 1] and found[-1][1] == kind and found[-1][0] == whose[w]:
            found[-1] = (*found[-1][:3], int(ends[w]))
        else:
            found.append((int(whose[w]), kind, int(starts[w]), int(ends[w])))
    out = []
    for t, kind, a, b in found:
        text = data[a:b].tobytes()
        b = a + len(text.rstrip(_TRIM))
        a = a + len(text) - len(text.lstrip(_TRIM))
        if a < b:
            out.append((t, kind, a, b))
    return out


def spans(field: Field, data: np.ndarray, offsets: np.ndarray):
    """For each text its base spans and added spans, as lists of (kind, start, end) in bytes of the block."""
    base: dict[int, list] = {}
    for t, k, a, b in base_spans(data, offsets):
        base.setdefault(t, []).append((k, a, b))
    more: dict[int, list] = {}
    for t, k, a, b in field_spans(field, data, offsets):
        if all(b <= x or y <= a for _, x, y in base.get(t, ())):
            more.setdefault(t, []).append((k, a, b))
    return base, more


def _rows(field: Field):
    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                base, more = spans(field, data, offsets)
                cols: list[list] = [[], [], [], [], [], []]
                for t in range(part.num_rows):
                    own, added = sorted(base.get(t, ())), more.get(t, ())
                    if own or added:
                        at = code_points(data[offsets[t] : offsets[t + 1]])
                        word = lambda x: f"{KINDS[x[0]]}:{at[x[1] - offsets[t]]}:{at[x[2] - offsets[t]]}"  # noqa: B023, E731
                        first, all_ = ",".join(map(word, own)), ",".join(map(word, sorted([*own, *added])))
                    else:
                        first = all_ = ""
                    for k in range(4):
                        cols[k].append(sum(x[0] == k for x in own))
                    cols[4].append(hashlib.sha256(first.encode()).hexdigest())
                    cols[5].append(all_)
                arrays = [part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: counts of base spans, their digest, and all spans as kind:start:end in code points."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows(trained()), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same columns; each span gives way to its kind in brackets. ``length_col`` gets the new count of code points."""
    field = trained()
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, text_col):
                base, more = spans(field, data, offsets)
                texts = part.column(columns.index(text_col))
                changed = sorted({*base, *more})
                if changed:
                    new = texts.to_pylist()
                    for t in changed:
                        out, at = [], int(offsets[t])
                        for k, a, b in sorted([*base.get(t, ()), *more.get(t, ())], key=lambda x: x[1:]):
                            if b <= at:
                                continue
                            out += [data[at : max(a, at)].tobytes(), f"[{KINDS[k].upper()}]".encode()]
                            at = b
                        new[t] = (b"".join(out) + data[at : offsets[t + 1]].tobytes()).decode("utf-8", "replace")
                    texts = pa.array(new, texts.type)
                arrays = list(part.columns)
                arrays[columns.index(text_col)] = texts
                if length_col in columns and changed:
                    where = columns.index(length_col)
                    arrays[where] = pc.cast(pc.utf8_length(texts), arrays[where].type)
                yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op1_pii_spans(docs: DataFrame) -> DataFrame:
    return pii_spans(docs)
