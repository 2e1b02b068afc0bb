"""Personal data: e-mail addresses, IP addresses, card and phone numbers, by patterns and a linear-chain CRF.

Patterns give the base spans. The conditional random field labels words by their shape, their neighbours' shapes and the
word before, in B/I form for the four kinds; it is trained by gradient ascent from a small labelled table, which
:func:`labelled_table` builds by rule, and decoded by Viterbi for a batch of chains at once. A word without digit or
``@`` is outside by definition; with its label known it separates the chain, so decoding the pieces between such words
is the decoding of the whole text. Spans of the CRF must hold what their kind needs (:func:`plausible`) and are added
where no base span lies.

Edge cases: null and empty texts have no spans; bytes that are no UTF-8 count as one unknown character each; spans are code-point offsets, end exclusive; the scans are linear in the
text, whatever it holds; repeated rows give repeated results; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.base import given_id, keyed_texts, record, text_strings

KINDS = ("email", "ip", "card", "phone")

# --- patterns --------------------------------------------------------------------------------------------------------

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: All matches of the number patterns lie in such runs.
_NUMBERS = re.compile(r"[0-9+][0-9 ().+\-]{6,}")
#: A match from inside a run of digits would also match from the run's start, so starts inside need no try.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    """At most 255, however many zeros come first."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _byte_parts(text: str) -> bool:
    return all(map(_is_byte, text.split(".")))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap: from each @ to the left as far as a local part goes, to the right by pattern."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (host := _HOST.match(text, at)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, host.end()))
                end = host.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, kinds as numbers of :data:`KINDS`."""
    spans = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    for run in _NUMBERS.finditer(text):
        part, at = run.group(), run.start()
        if part.count(".") >= 3:
            spans += [(at + m.start(), 1, at + m.end()) for m in _IP.finditer(part) if _byte_parts(m.group())]
        if len(part) >= 14:
            for m in _CARD.finditer(part):
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at + m.start(), 2, at + m.end()))
        if "+" in part:
            spans += [(at + m.start(), 3, at + m.end()) for m in _PHONE.finditer(part) if 10 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(spans)


# --- words and features ----------------------------------------------------------------------------------------------

_MARKED = re.compile(r"[0-9@]")


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of neighbouring words (between white space) with a digit or @, as (start, end) of each word."""
    found: list[list[tuple[int, int]]] = []
    mark = _MARKED.search(text)
    last = -1
    while mark:
        start = mark.start()
        while start > last + 1 and not text[start - 1].isspace():
            start -= 1
        end = mark.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if found and text[found[-1][-1][1]:start].isspace() and "\n" not in text[found[-1][-1][1]:start]:
            found[-1].append((start, end))
        else:
            found.append([(start, end)])
        last = end
        mark = _MARKED.search(text, end)
    return found


def shape(word: str) -> str:
    """Digits as d, letters as x or X, all else as it is; runs over four are one sign and +."""
    signs = "".join("d" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{4,}", r"\1+", signs)


def word_features(word: str) -> list[str]:
    form = shape(word)
    digits = sum(map(str.isdigit, word))
    letters = sum(map(str.isalpha, word))
    return ["s=" + form, "c=" + re.sub(r"(.)\1+", r"\1", form), f"n={min(digits, 20)}", f"a={min(letters, 3)}",
            f"@={'@' in word}", f".={min(word.count('.'), 4)}", "b=" + form[:1], f"-={min(word.count('-'), 4)}"]


def chain_features(words: list[str], before: str) -> list[list[str]]:
    own = [word_features(w) for w in words]
    out = []
    for k, features in enumerate(own):
        left = own[k - 1][1] if k else "w=" + before.lower().strip(".,:;()\"'")
        right = own[k + 1][1] if k + 1 < len(own) else "end"
        out.append([*features, "l" + left, "r" + right, "l" + left + "|" + features[1]])
    return out


def _word_before(text: str, start: int) -> str:
    """The word before a chain, over all blanks between; each gap of a text is walked once."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    first = end
    while first and not text[first - 1].isspace():
        first -= 1
    return text[first:end]


# --- the model -------------------------------------------------------------------------------------------------------

LABELS = ["O", *(f"{side}-{kind}" for kind in KINDS for side in "BI")]


class ChainModel:
    """Weights of features by label, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, chain: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(chain), len(LABELS)))
        for k, features in enumerate(chain):
            known = [self.index[f] for f in features if f in self.index]
            if known:
                out[k] = self.emit[known].sum(axis=0)
        return out

    def decode(self, chains_: list[list[list[str]]]) -> list[np.ndarray]:
        """Best labels of each chain: Viterbi over all chains of like length at once."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(chains_)
        by_length: dict[int, list[int]] = {}
        for k, chain in enumerate(chains_):
            by_length.setdefault(len(chain), []).append(k)
        for length, members in by_length.items():
            scores = np.stack([self.scores(chains_[k]) for k in members])
            best = scores[:, 0] + _START
            back = np.zeros((length, len(members), len(LABELS)), dtype=np.int8)
            for t in range(1, length):
                paths = best[:, :, None] + self.move[None]
                back[t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + scores[:, t]
            labels = np.zeros((len(members), length), dtype=np.int64)
            labels[:, -1] = best.argmax(axis=1)
            for t in range(length - 1, 0, -1):
                labels[:, t - 1] = back[t][np.arange(len(members)), labels[:, t]]
            for row, k in enumerate(members):
                out[k] = labels[row]
        return out


#: A chain cannot start inside a span, nor can I follow anything but B or I of its kind.
_START = np.array([-1e4 if name.startswith("I") else 0.0 for name in LABELS])
_ALLOWED = np.array([[0.0 if not b.startswith("I") or a[2:] == b[2:] and a != "O" else -1e4 for b in LABELS] for a in LABELS])


def train(table: list[tuple[list[str], str, list[str]]], rounds: int = 120, rate: float = 0.3, penalty: float = 1e-3) -> ChainModel:
    """Fit by Adam on the conditional log-likelihood less an L2 penalty. ``table``: words, the word before, labels."""
    examples = [(chain_features(words, before), [LABELS.index(x) for x in labels]) for words, before, labels in table]
    index: dict[str, int] = {}
    for chain, _ in examples:
        for features in chain:
            for f in features:
                index.setdefault(f, len(index))
    n = len(LABELS)
    lengths = sorted({len(c) for c, _ in examples})
    groups = []
    for length in lengths:  # features of a chain's words as a fixed number of indices
        own = [(c, y) for c, y in examples if len(c) == length]
        groups.append((np.array([[[index[f] for f in features] for features in c] for c, _ in own]), np.array([y for _, y in own])))
    emit, move = np.zeros((len(index), n)), np.zeros((n, n))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        grad_emit, grad_move = -penalty * len(examples) * emit, -penalty * len(examples) * move
        for x, y in groups:
            scores = emit[x].sum(axis=2)  # chains, places, labels
            size, length = y.shape
            rows = np.arange(size)
            moves = move + _ALLOWED
            ahead = [scores[:, 0] + _START]
            for t in range(1, length):
                ahead.append(np.logaddexp.reduce(ahead[-1][:, :, None] + moves, axis=1) + scores[:, t])
            behind = [np.zeros((size, n))]
            for t in range(length - 1, 0, -1):
                behind.insert(0, np.logaddexp.reduce(moves[None] + (scores[:, t] + behind[0])[:, None, :], axis=2))
            whole = np.logaddexp.reduce(ahead[-1], axis=1)
            for t in range(length):
                delta = -np.exp(ahead[t] + behind[t] - whole[:, None])
                delta[rows, y[:, t]] += 1
                np.add.at(grad_emit, x[:, t], delta[:, None, :])
                if t:
                    pairs = np.exp(ahead[t - 1][:, :, None] + moves + (scores[:, t] + behind[t])[:, None, :] - whole[:, None, None])
                    grad_move -= pairs.sum(axis=0)
                    np.add.at(grad_move, (y[:, t - 1], y[:, t]), 1)
        for weights, grad, m, v in ((emit, grad_emit, *moments[:2]), (move, grad_move, *moments[2:])):
            grad = grad / len(examples)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            weights += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return ChainModel(index, emit, move + _ALLOWED)


def labelled_table(rows: int = 900, seed: int = 7) -> list[tuple[list[str], str, list[str]]]:
    """Chains of words with a digit or @, the word before and the labels, made by rule."""
    rng = random.Random(seed)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def marked(words, kind):
        return words, [("B-" if k == 0 else "I-") + kind for k in range(len(words))]
    neutral = ["the", "and", "is", "la", "de", "und", "el", "from", "in", ""]
    cue = {"phone": ["call", "tel", "phone", "telefon", "mobile", "fax", "tél"], "card": ["card", "visa", "karte", "tarjeta", "carte"],
           "email": ["mail", "email", "contact", "an", "to"], "ip": ["ip", "host", "address", "server"]}

    def one():
        pick = rng.randrange(16)
        any_cue = rng.choice(cue["phone"] + cue["card"])
        if pick == 0:
            return *marked([f"{letters(rng.randint(1, 8))}{rng.choice(['', '.', '_'])}{digits(rng.randint(0, 2))}{letters(2)}@{letters(5)}.{rng.choice(['com', 'org', 'de'])}" + rng.choice(["", ".", ","])], "email"), rng.choice(neutral + cue["email"])
        if pick == 1:
            return *marked([f"{letters(rng.randint(2, 8))}@{letters(rng.randint(4, 9))}"], "email"), rng.choice(cue["email"])
        if pick == 2:
            return *marked([".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", ".", ",", ":8080"])], "ip"), rng.choice(neutral + cue["ip"])
        if pick == 3:
            return *marked([digits(4) for _ in range(4)], "card"), rng.choice(cue["card"])
        if pick == 4:
            return *marked([rng.choice([digits(16), f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}"])], "card"), rng.choice(cue["card"])
        if pick == 5:
            return *marked([f"+{digits(rng.randint(1, 2))}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"), rng.choice(neutral + cue["phone"])
        if pick == 6:
            return *marked([f"({digits(3)})", f"{digits(3)}-{digits(4)}" + rng.choice(["", ".", ","])], "phone"), rng.choice(neutral + cue["phone"])
        if pick == 7:
            return *marked([f"{digits(3)}-{digits(3)}-{digits(4)}"], "phone"), rng.choice(neutral + cue["phone"])
        if pick == 8:
            return *marked([rng.choice([digits(3), "0" + digits(3)]), rng.choice([digits(4), digits(6), digits(7)])], "phone"), rng.choice(cue["phone"])
        plain = {9: [digits(rng.randint(1, 4))], 10: [f"{digits(2)}.{digits(rng.randint(1, 3))}" + rng.choice(["", "%", ","])],
                 11: [f"{rng.randint(1900, 2100)}-{digits(2)}-{digits(2)}"], 12: [f"{digits(2)}:{digits(2)}"],
                 13: ['"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'],
                 14: [rng.choice([f"{letters(4)}{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"@{letters(6)}", f"${digits(2)}.{digits(2)}", f"#{digits(4)}"])],
                 15: [rng.choice([digits(16), digits(12), digits(9), digits(7)])]}[pick]
        return plain, ["O"] * len(plain), rng.choice(neutral + ([any_cue] if pick in (9, 10, 11, 12) else []))
    out = []
    for _ in range(rows):
        words, labels, before = one()
        for _ in range(rng.choice([0, 0, 0, 1])):
            more, tags, _ = one()
            words, labels = words + more, labels + tags
        out.append((words, before, labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> ChainModel:
    return train(labelled_table())


def plausible(kind: int, text: str) -> bool:
    """What a span of the CRF must hold."""
    digits = len(_DIGITS.findall(text))
    if kind == 0:
        return "@" in text[1:-1]
    if kind == 1:
        parts = text.split(":")[0].split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _is_byte(p) for p in parts)
    return (13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15) and not any(c.isalpha() for c in text)


def find_spans(texts: list[str], model: ChainModel) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, as (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    places, inputs = [], []
    for row, text in enumerate(texts):
        for chain in chains(text):
            places.append((row, chain))
            inputs.append(chain_features([text[a:z] for a, z in chain], _word_before(text, chain[0][0])))
    added: list[list] = [[] for _ in texts]
    for (row, chain), labels in zip(places, model.decode(inputs)):
        k = 0
        while k < len(chain):
            if labels[k] == 0:
                k += 1
                continue
            kind, first = (int(labels[k]) - 1) // 2, k
            k += 1
            while k < len(chain) and LABELS[labels[k]].startswith("I"):
                k += 1
            start, end = chain[first][0], chain[k - 1][1]
            text = texts[row]
            while end > start and text[end - 1] in ".,;:!?\"')]}>":
                end -= 1
            while start < end and text[start] in ",;:\"'[{<":
                start += 1
            if start < end and plausible(kind, text[start:end]) and not any(a < end and start < z for a, _, z in base[row]):
                added[row].append((start, kind, end))
    return list(zip(base, added))


_SPAN = "struct<start:long,end:long,kind:string,base:boolean>"
_FOUND = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])))])


def personal_data(docs: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """(id, spans) per row: spans by start, then kind, as structs of code-point offsets, kind, and whether a pattern gave it."""
    model = model or default_model()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights, whatever the input

    def run(batches):
        for batch in batches:
            found = find_spans(list(text_strings(batch.column("text"))), shared.value)
            told = [sorted([(a, k, z, True) for a, k, z in base] + [(a, k, z, False) for a, k, z in added]) for base, added in found]
            yield record(_FOUND, id=batch.column("id"), spans=[
                [{"start": a, "end": z, "kind": KINDS[k], "base": is_base} for a, k, z, is_base in spans] for spans in told])
    return keyed_texts(docs).mapInArrow(run, f"id long, spans array<{_SPAN}>")


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """The columns of query op8: counts and digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_data(docs, model).select(
        given_id(), *map(count, KINDS),
        F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
