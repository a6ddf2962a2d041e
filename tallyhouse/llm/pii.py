"""Personal data: fixed patterns, and a semi-Markov conditional random field for the rest.

Around every digit and ``@`` the text is cut into atoms (letters, digits, single marks).
Every run of up to ``MAX_ATOMS`` atoms that could be an entity is a candidate segment, with
features of the whole span: its shape, its number of digits and groups, separators, check
sum, and the words before it. The model scores segments and the step from one label to the
next; dynamic programming over segment ends picks the best segmentation, that is boundaries
and types together. It is trained here by gradient ascent on the likelihood of whole
segmentations, on examples made from rules. Spans by pattern stay as they are; the model
adds what it finds in between, such as numbers written in national ways.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import map_texts, text_of

# The kinds in the order in which ties are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_FIELDS = ("start", "kind_rank", "end", "kind", "base")
SPANS = "array<struct<start:int,kind_rank:int,end:int,kind:string,base:boolean>>"
MAX_ATOMS = 16
NEAR = 24
_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.DOTALL)
_TRIGGER = re.compile(r"[0-9@]")
_HINTS = {
    "email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "mastercard", "amex", "credit"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell"},
    "other": {"iban", "isbn", "order", "tax", "invoice", "version", "date", "account", "ref", "no", "nr", "ssn"},
}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(start, kind's place, end)`` by pattern, in linear time on any text."""
    found = []
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and EMAIL_NAME.match(text[start - 1]):
            start -= 1
        m = EMAIL_HOST.match(text, at) if start < at else None
        upto = m.end() if m else at + 1
        if m:
            found.append((start, 0, upto))
        at = text.find("@", upto)
    for m in IP.finditer(text):
        if all(_byte(part) for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


# --- the model ---------------------------------------------------------------------


def _shape(text: str) -> str:
    """Letters as ``a``, digits as ``0``, runs of one character as a single one."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", text)))


def segment_features(span: str, before: str, after: str = "") -> list[str] | None:
    """Features of a candidate segment with the text around it; None if it can be no entity."""
    digits = sum(c.isdigit() for c in span)
    at = span.count("@")
    if "\n" in span or not (span[-1].isalnum()) or not (span[0].isalnum() or span[0] in "+("):
        return None
    letters = any(c.isalpha() for c in span)
    if at > 1 or (at and " " in span) or (not at and (letters or digits < 4)):
        return None
    groups = re.findall(r"[0-9]+", span)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    out = [f"digits={min(digits, 20)}", f"groups={min(len(groups), 6)}", f"marks={marks}", f"letters={letters}"]
    out += [f"shape={_shape(span)[:16]}", f"prev={_shape(before)[-3:]}", f"next={_shape(after)[:2]}"]
    if at:
        name, host = span.split("@")
        out.append(f"mail={bool(name) and bool(host)},{host.count('.') > 0},{' ' in span}")
    elif not letters:
        whole = "".join(groups)
        out.append(f"luhn={12 <= digits <= 19 and luhn(whole)}")
        out.append(f"octets={len(groups) == 4 and all(_byte(g) for g in groups)},{marks}")
        out.append("sizes=" + ",".join(str(len(g)) for g in groups[:6]))
        out.append(f"first={span[0] if span[0] in '+(0' else '9'},{marks},{min(digits, 16)}")
    words = set(re.findall(r"[a-z]+", before.lower()[-NEAR:]))
    out += [f"hint={kind}" for kind, hints in _HINTS.items() if words & hints]
    return out


def _joined(atoms: list[str], k: int) -> bool:
    """Whether the border before atom ``k`` lies inside a run of letters and digits."""
    return 0 < k < len(atoms) and atoms[k - 1][-1].isalnum() and atoms[k][0].isalnum()


class SemiMarkov:
    """Linear-chain model over segments; label 0 is a single atom outside any entity."""

    def __init__(self, weights: dict[tuple[str, int], float], steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def lattice(self, atoms: list[str]) -> list[list[tuple[int, int, list[str]]]]:
        """For each segment end the candidates ``(start, label, features)``."""
        ends: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(atoms) + 1)]
        for i in range(len(atoms)):
            ends[i + 1].append((i, 0, ["outside=" + ("digit" if atoms[i][0].isdigit() else "other")]))
            span, before = "", "".join(atoms[max(0, i - 8) : i])
            for j in range(i, min(len(atoms), i + MAX_ATOMS)):
                span += atoms[j]
                if atoms[j] == "\n":
                    break
                if _joined(atoms, i) or _joined(atoms, j + 1):
                    continue  # an end inside a run of letters and digits
                after = "".join(atoms[j + 1 : j + 3])
                if (features := segment_features(span, before, after)) is not None:
                    ends[j + 1] += [(i, label, features) for label in range(1, len(KINDS) + 1)]
        return ends

    def score(self, label: int, features: list[str]) -> float:
        return sum(self.weights.get((f, label), 0.0) for f in features)

    def best(self, atoms: list[str]) -> list[tuple[int, int, int]]:
        """Entities ``(first atom, label, end atom)`` of the best segmentation."""
        ends, labels = self.lattice(atoms), len(KINDS) + 1
        value = np.full((len(atoms) + 1, labels), -np.inf)
        value[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for end in range(1, len(atoms) + 1):
            for start, label, features in ends[end]:
                prior = value[start] + self.steps[:, label]
                chosen = int(np.argmax(prior))
                total = prior[chosen] + self.score(label, features)
                if total > value[end, label]:
                    value[end, label], back[end, label] = total, (start, chosen)
        end, label, found = len(atoms), int(np.argmax(value[-1])), []
        while end > 0:
            start, prior = back[end, label]
            if label:
                found.append((start, label, end))
            end, label = start, prior
        return found[::-1]

    def learn(self, atoms: list[str], gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the log-likelihood of a segmentation."""
        ends, labels = self.lattice(atoms), len(KINDS) + 1
        inside = {k for i, _, j in gold for k in range(i, j)}
        n = len(atoms)
        arcs = [(s, lab, e, f, self.score(lab, f)) for e in range(1, n + 1) for s, lab, f in ends[e]]
        alpha = np.full((n + 1, labels), -np.inf)
        alpha[0, 0] = 0.0
        for s, lab, e, _, w in arcs:
            alpha[e, lab] = np.logaddexp(alpha[e, lab], np.logaddexp.reduce(alpha[s] + self.steps[:, lab]) + w)
        beta = np.full((n + 1, labels), -np.inf)
        beta[n] = 0.0
        for s, lab, e, _, w in reversed(arcs):
            beta[s] = np.logaddexp(beta[s], self.steps[:, lab] + w + beta[e, lab])
        norm = np.logaddexp.reduce(alpha[n])
        change = np.zeros_like(self.steps)
        label_at = {j: lab for _, lab, j in gold}
        for s, lab, e, features, w in arcs:
            mass = np.exp(alpha[s] + self.steps[:, lab] + w + beta[e, lab] - norm)
            true = (s, lab, e) in gold or (lab == 0 and s not in inside)
            change[:, lab] -= mass
            if true:
                change[label_at.get(s, 0), lab] += 1
            slope = rate * (true - mass.sum())
            if abs(slope) > 1e-6:
                for f in features:
                    self.weights[f, lab] = self.weights.get((f, lab), 0.0) + slope
        self.steps += rate * change


def examples(n: int, seed: int) -> list[tuple[list[str], set[tuple[int, int, int]]]]:
    """Sentences made by rule, as atoms with their entities."""
    rng = np.random.default_rng(seed)

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def word() -> str:
        return "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))

    def choose(*ways: Callable[[], str]) -> str:
        return ways[rng.integers(len(ways))]()

    def numbers(*sizes: int) -> list[str]:
        return [digits(k) for k in sizes]

    def phone() -> str:
        a, b, c = numbers(3, 3, 4)
        area, mark = digits(int(rng.integers(1, 5))), str(rng.choice([" ", "/", "-"]))
        return choose(
            lambda: f"+1 ({a}) {b}-{c}", lambda: f"+{digits(2)} {a} {b} {c}", lambda: f"({a}) {b}-{c}", lambda: f"{a}-{b}-{c}",
            lambda: f"+1{a}{b}{c}", lambda: f"{a}.{b}.{c}",
            lambda: f"0{area}{mark}{digits(int(rng.integers(6, 9)))}", lambda: f"(0{area}) {digits(int(rng.integers(6, 9)))}",
            lambda: f"0{area}{mark}{digits(3)} {digits(4)}", lambda: " ".join(["0" + digits(1), *numbers(2, 2, 2, 2)]),
        )

    def card(valid: bool) -> str:
        body = digits(15)
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)) == valid)
        return str(rng.choice(["", " ", "-"])).join(number[k : k + 4] for k in range(0, 16, 4))

    def entity(label: int) -> str:
        if label == 1:
            return f"{word()}{rng.choice(['', '.', '_', '-'])}{digits(rng.integers(0, 3))}@{word()}{digits(rng.integers(0, 2))}.{rng.choice(['com', 'org', 'example.net', 'io'])}"
        if label == 2:
            return ".".join(str(k) for k in rng.integers(0, 256, 4))
        return card(True) if label == 3 else phone()

    def octets() -> str:
        parts = [str(k) for k in rng.integers(0, 256, 4)]
        parts[rng.integers(4)] = str(rng.integers(256, 1000))
        return ".".join(parts)

    def letters(k: int) -> str:
        return "".join(rng.choice(list("ABCDEFGHIKLMNOPRSTUVWXYZ"), k))

    def named(names: list[str], value: str) -> str:
        return f"{rng.choice(names)}{rng.choice([' ', ': ', ' number '])}{value}" if rng.random() < 0.6 else value

    def noise() -> str:
        year, month, day = rng.integers(1900, 2030), rng.integers(1, 13), rng.integers(1, 29)
        return choose(
            lambda: f"{year}", lambda: f"{year}-{month:02}-{day:02}", lambda: f"{day:02}.{month:02}.{year}", lambda: f"{month:02}/{day:02}/{year}",
            lambda: f"{year}-{month:02}-{day:02} {digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(2)}",
            lambda: named(["order", "invoice", "ref"], choose(lambda: digits(5), lambda: digits(8), lambda: f"{digits(5)}-{digits(5)}", lambda: f"{digits(3)}-{digits(7)}")),
            lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: named(["version"], f"{digits(1)}.{digits(2)}.{digits(4)}"),
            lambda: f"{digits(3)},{digits(3)}", lambda: f"@{word()}", lambda: word() + digits(3), lambda: digits(16),
            lambda: f"{word()}={rng.bytes(9).hex()}", lambda: card(False), lambda: f"card {card(False)}", octets, lambda: f"host {octets()}",
            lambda: named(["IBAN", "account"], f"{letters(2)}{digits(2)} " + " ".join(numbers(*[4] * int(rng.integers(3, 6)), 2))),
            lambda: named(["tax", "SSN"], "-".join(numbers(3, 2, 4))),
            lambda: named(["ISBN"], f"{rng.choice(['978', '979'])}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"),
            lambda: named(["ISBN"], f"{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}"),
            lambda: f"{digits(2)} {digits(3)} {digits(3)}", lambda: f"{digits(4)}-{digits(4)}",
        )

    out = []
    for _ in range(n):
        atoms, gold = [], set()
        for _ in range(rng.integers(1, 4)):
            atoms += _atoms("".join(f" {word()}" for _ in range(rng.integers(1, 4))) + " ")
            label = int(rng.integers(0, len(KINDS) + 1))
            if label and rng.random() < 0.3:
                atoms += _atoms(str(rng.choice(sorted(_HINTS[KINDS[label - 1]]))) + str(rng.choice([" ", ": "])))
            new = _atoms(entity(label) if label else noise())
            if label:
                gold.add((len(atoms), label, len(atoms) + len(new)))
            atoms += new + _atoms(str(rng.choice([" ", ", ", ". ", "\n"])))
        out.append((atoms, gold))
    return out


def _atoms(text: str) -> list[str]:
    return _ATOM.findall(text)


@lru_cache(maxsize=4)
def trained(n: int = 900, rounds: int = 3, seed: int = 11) -> SemiMarkov:
    """The model, trained on ``n`` made examples."""
    model = SemiMarkov({}, np.zeros((len(KINDS) + 1,) * 2))
    for k in range(rounds):
        for atoms, gold in examples(n, seed):
            model.learn(atoms, gold, 0.3 / (k + 1))
    return model


# --- whole texts -------------------------------------------------------------------


def all_spans(text: str, model: SemiMarkov) -> list[tuple[int, int, int, str, bool]]:
    """Spans by pattern, and those the model adds between them, sorted by start and kind."""
    base = base_spans(text)
    out = [(s, k, e, KINDS[k], True) for s, k, e in base]
    taken, at = sorted((s, e) for s, _, e in base), 0
    for start, end in _regions(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        left, k = start, at
        while left < end:  # the parts of the region outside the base spans
            stop = min(end, taken[k][0]) if k < len(taken) else end
            if left < stop and _TRIGGER.search(text, left, stop):
                part = text[left:stop]
                atoms = _atoms(part)
                places = np.cumsum([left] + [len(a) for a in atoms])
                for i, label, j in model.best(atoms):
                    out.append((int(places[i]), label - 1, int(places[j]), KINDS[label - 1], False))
            if k >= len(taken):
                break
            left, k = max(left, taken[k][1]), k + 1
    return sorted(out)


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and ``@``, whose ends do not cut runs of letters and digits."""
    start = end = None
    for m in _TRIGGER.finditer(text):
        if end is None or m.start() > end:
            if end is not None:
                yield start, end
            start = max(end or 0, m.start() - NEAR)
            while start > (end or 0) and text[start].isalnum() and text[start - 1].isalnum():
                start -= 1
        if end is None or m.end() + NEAR > end:
            end = min(m.end() + NEAR, len(text))
            while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
    if end is not None:
        yield start, end


def find_personal_data(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: SemiMarkov | None = None
) -> DataFrame:
    """One row per row: ``id`` and ``spans``, an array of ``(start, kind_rank, end, kind, base)``.

    Positions are code points, ``end`` exclusive; ``base`` marks spans by pattern, which may
    overlap across kinds. Spans that the model adds overlap none. NULL text is empty and has
    none. Whole texts are read, in one pass without a shuffle; other columns are ignored,
    repeated rows are searched each, and an empty table gives no row. The model is a few
    thousand weights that travel with the task.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    chosen = model or trained()

    def make():
        return lambda texts: [[[dict(zip(_FIELDS, s)) for s in all_spans(t, chosen)] for t in texts]]

    return map_texts(rows, make, f"spans {SPANS}")
